"""Search for several queries at once: the whole rule scorer, boosted fields, reciprocal rank fusion, highlights, suggestions of words."""

from __future__ import annotations

from dataclasses import asdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivan.functions.text import _DST, _SRC, fold, shingles, tokens
from scrivan.operators.index import SQL as IDX
from scrivan.operators.index import doc_index, sql_fold, sql_tokens
from scrivan.operators.lexicon import INSTITUTIONAL, SYNONYMS, Spec, corrected, folded
from scrivan.operators.search import B, K1, top
from scrivan.runtime import stage

N = F.count
#: The searches that are run together; any table of queries may stand for them.
SEARCHES = {1: "học bổng khuyến khích", 2: "xin ktx", 3: "vay vốn", 4: "thông báo", 5: "thu vien so", 6: "bao hiem y te", 7: "lich thi hoc ky", 8: "chuyen de ngoai tru", 9: "thu viem", 10: "quyết định kinh phí"}
_SPEC = "qid int, q string, terms array<string>, syns array<string>, pairs array<string>, topics array<string>, forms array<string>, words array<string>, full string, plain boolean"


def specs(spark: SparkSession, queries: dict[int, str]) -> DataFrame:
    """The rewritten queries as a small table."""
    rows = [{"qid": k, **asdict(Spec.of(q))} for k, q in queries.items()]
    return spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in _SPEC.split(", ")) for r in rows], _SPEC)


def _lit(x) -> str:
    if isinstance(x, list):
        return "[" + ", ".join(map(_lit, x)) + "]::VARCHAR[]"
    return str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _specs_sql(queries: dict[int, str]) -> str:
    rows = ", ".join("(" + ", ".join(map(_lit, (k, *asdict(Spec.of(q)).values()))) + ")" for k, q in queries.items())
    return f"spec AS (SELECT * FROM (VALUES {rows}) v(qid, q, terms, syns, pairs, topics, forms, words, full_, plain))"


def searchable(spark: SparkSession, d: str) -> DataFrame:
    """Each document folded and cut into words once, written out: every query reads this."""
    i = doc_index(spark, d)
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    inst = reduce(lambda a, b: a | b, [F.col("title").startswith(p) for p in INSTITUTIONAL])
    f = i.select("id", "created_at", fold(e("title")).alias("t"), fold(e("body")).alias("x"), fold(e("document_number")).alias("num"), fold(e("student_id")).alias("sid"), F.coalesce(inst, F.lit(False)).alias("inst"))
    word = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return stage(f.withColumns({"tt": word("t"), "xt": word("x")}))


_DOCS_SQL = rf"""docs AS (SELECT *, list_distinct(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+')) AS tt, list_distinct(regexp_extract_all(x, '[\p{{L}}\p{{N}}_]+')) AS xt FROM (SELECT id, created_at, {sql_fold("coalesce(title, '')")} AS t, {sql_fold("coalesce(body, '')")} AS x, {sql_fold("coalesce(document_number, '')")} AS num, {sql_fold("coalesce(student_id, '')")} AS sid, coalesce({' OR '.join(f"starts_with(title, '{p}')" for p in INSTITUTIONAL)}, false) AS inst FROM idx))"""


def rule_score(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(qid, id, score, created_at) of every document that fits a query; the queries are a handful and broadcast.

    Documents outside the query's field of work drop out; inside it 160 (title) or 80 (text). A whole phrase replaces
    that by 200 and twice its length (title) or 100 (text); a document or student number gives 180 at least. Where
    nothing fits yet: related terms 160 or 75 and 15 for each topic word in the title, then word pairs 130 + 25 each in
    the title or 70 + 15 each in the text, then topic words alone, then words of the form; last, a title word one
    letter away gives 65. Documents of an institutional kind gain 25 beside another hit than the phrase.
    """
    c = F.col
    some = lambda a, of: F.exists(c(a), lambda w: c(of).contains(w))
    many = lambda a, of: F.size(F.filter(c(a), lambda w: c(of).contains(w)))
    whole = lambda a, words, text: F.size(F.filter(c(a), lambda w: F.when(F.regexp_like(w, F.lit(r"^\w+$")), F.array_contains(c(words), w)).otherwise(c(text).contains(w))))
    rows = docs.crossJoin(F.broadcast(wanted)).withColumns({"dt": some("terms", "t"), "dx": some("terms", "x")})
    rows = rows.where((F.size("terms") == 0) | c("dt") | c("dx"))
    rows = rows.withColumn("base", F.when(c("dt"), 160).when(c("dx"), 80).otherwise(0)).withColumn("phrase", F.when(c("t").contains(c("q")), 200 + 2 * F.length("q")).when(c("x").contains(c("q")), 100).otherwise(0))
    number = lambda n: (c(n) != "") & (c(n).contains(c("q")) | c("q").contains(c(n)))
    known = F.when(c("phrase") > 0, c("phrase")).otherwise(c("base"))
    known = F.when(number("num") | number("sid"), F.greatest(known, F.lit(180))).otherwise(known)
    n, nt, nx = F.size("topics"), whole("topics", "tt", "t"), whole("topics", "xt", "x")
    pt, px, nf = many("pairs", "t"), many("pairs", "x"), whole("forms", "tt", "t")
    single = F.when(nt > 0, 95).when(nx > 0, 45).otherwise(0)
    several = F.when(nt >= n, 115 + 10 * nt).when((nt >= 1) & (nx >= n - 1), 75).when(nx >= n, 55).otherwise(0)
    loose = (
        F.when(some("syns", "t"), 160 + 15 * nt).when(some("syns", "x"), 75 + 15 * nt).when(pt > 0, 130 + 25 * pt).when(px > 0, 70 + 15 * px)
        .when(n == 1, single).when(n > 1, several).when(nf > 0, 30 + 5 * nf).otherwise(0)
    )
    rows = rows.withColumn("s", known).withColumn("s", F.when(c("s") > 0, c("s")).otherwise(loose))
    apart = lambda a, b: F.size(F.filter(F.sequence(F.lit(1), F.least(F.length(a), F.length(b))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    near = F.exists(c("topics"), lambda w: (F.length(w) >= 3) & F.exists(F.split("t", " "), lambda o: (o != "") & (F.abs(F.length(w) - F.length(o)) <= 1) & (apart(w, o) <= 1)))
    rows = rows.withColumn("s", F.when(c("s") > 0, c("s") + F.when((c("phrase") == 0) & c("inst") & c("plain"), 25).otherwise(0)).when(near, 65).otherwise(0))
    return rows.where("s > 0").select("qid", "id", c("s").alias("score"), "created_at")


def _rule_sql() -> str:
    some = lambda a, of: f"len(list_filter({a}, lambda w: contains({of}, w))) > 0"
    many = lambda a, of: f"len(list_filter({a}, lambda w: contains({of}, w)))"
    whole = lambda a, words, text: f"len(list_filter({a}, lambda w: CASE WHEN regexp_matches(w, '^\\w+$') THEN list_contains({words}, w) ELSE contains({text}, w) END))"
    number = lambda n: f"({n} <> '' AND (contains({n}, q) OR contains(q, {n})))"
    near = "len(list_filter(topics, lambda w: length(w) >= 3 AND len(list_filter(string_split(t, ' '), lambda o: o <> '' AND abs(length(w) - length(o)) <= 1 AND len(list_filter(range(1, least(length(w), length(o)) + 1), lambda i: w[i] <> o[i])) <= 1)) > 0)) > 0"
    return f"""{IDX}, {_DOCS_SQL}, {_specs_sql(SEARCHES)},
g AS (SELECT *, {some('terms', 't')} AS dt, {some('terms', 'x')} AS dx FROM docs, spec),
p AS (SELECT *, CASE WHEN dt THEN 160 WHEN dx THEN 80 ELSE 0 END AS base, CASE WHEN contains(t, q) THEN 200 + 2 * length(q) WHEN contains(x, q) THEN 100 ELSE 0 END AS phrase, len(topics) AS n, {whole('topics', 'tt', 't')} AS nt, {whole('topics', 'xt', 'x')} AS nx, {many('pairs', 't')} AS pt, {many('pairs', 'x')} AS px, {whole('forms', 'tt', 't')} AS nf FROM g WHERE len(terms) = 0 OR dt OR dx),
k AS (SELECT *, CASE WHEN {number('num')} OR {number('sid')} THEN greatest(CASE WHEN phrase > 0 THEN phrase ELSE base END, 180) WHEN phrase > 0 THEN phrase ELSE base END AS s0 FROM p),
l AS (SELECT *, CASE WHEN s0 > 0 THEN s0 WHEN {some('syns', 't')} THEN 160 + 15 * nt WHEN {some('syns', 'x')} THEN 75 + 15 * nt WHEN pt > 0 THEN 130 + 25 * pt WHEN px > 0 THEN 70 + 15 * px WHEN n = 1 THEN CASE WHEN nt > 0 THEN 95 WHEN nx > 0 THEN 45 ELSE 0 END
  WHEN n > 1 THEN CASE WHEN nt >= n THEN 115 + 10 * nt WHEN nt >= 1 AND nx >= n - 1 THEN 75 WHEN nx >= n THEN 55 ELSE 0 END WHEN nf > 0 THEN 30 + 5 * nf ELSE 0 END AS s1 FROM k),
ruled AS (SELECT qid, id, created_at, score FROM (SELECT qid, id, created_at, CASE WHEN s1 > 0 THEN s1 + CASE WHEN phrase = 0 AND inst AND plain THEN 25 ELSE 0 END WHEN {near} THEN 65 ELSE 0 END AS score FROM l) WHERE score > 0)"""


def cut_off(scored: DataFrame) -> DataFrame:
    """Of each query, what scores above a share of its best."""
    best = scored.groupBy("qid").agg(F.max("score").alias("m"))
    floor = F.when(F.col("m") >= 120, F.greatest(0.5 * F.col("m"), F.lit(80.0))).when(F.col("m") >= 70, F.greatest(0.6 * F.col("m"), F.lit(50.0))).otherwise(0.0)
    return scored.join(F.broadcast(best), "qid").where(F.col("score") >= floor).drop("m")


_CUT = "best AS (SELECT qid, max(score) AS m FROM ruled GROUP BY qid), kept AS (SELECT ruled.* FROM ruled JOIN best USING (qid) WHERE score >= CASE WHEN m >= 120 THEN greatest(0.5 * m, 80) WHEN m >= 70 THEN greatest(0.6 * m, 50) ELSE 0 END)"


def rules(spark: SparkSession, d: str) -> DataFrame:
    """(qid, id, score, rank): all searches by the rule scorer, cut off below a share of each best; ties by newest."""
    scored = stage(rule_score(searchable(spark, d), specs(spark, SEARCHES)))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("created_at"), "id")
    return cut_off(scored).withColumn("rank", F.row_number().over(w)).select("qid", "id", "score", "rank")


RULES_SQL = f"WITH {_rule_sql()}, {_CUT} SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, created_at DESC, id) AS rank FROM kept"


def hashed_vectors(docs: DataFrame) -> DataFrame:
    """(id, idx, v): signed hashed words (as written and folded) and word pairs of a text in 768 places, to unit length."""
    raw, low = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), tokens("text")
    words = docs.repartition("id").select("id", raw.alias("r"), low.alias("f"))
    t = words.select("id", F.explode(F.concat(F.array_distinct(F.concat("r", "f")), shingles(F.col("r"), 2), shingles(F.col("f"), 2))).alias("t")).withColumn("h", F.md5("t"))
    m256 = F.conv(F.substring("h", 31, 2), 16, 10).cast("int")
    m3 = F.aggregate(F.split("h", ""), F.lit(0), lambda s, c: s + F.when(c == "", 0).otherwise(F.instr(F.lit("123456789abcdef"), c))) % 3
    sign = F.when(F.conv(F.substring("h", 28, 1), 16, 10).cast("int") % 2 == 1, -1.0).otherwise(1.0)
    v = t.select("id", (m256 + 256 * F.pmod(m3 - m256, F.lit(3))).alias("idx"), sign.alias("s")).groupBy("id", "idx").agg(F.sum("s").alias("v")).where("v <> 0")
    return v.withColumn("v", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("id"))))


def _vectors_sql(name: str, of: str) -> str:
    """Common table expressions that end in ``name`` (id, idx, v) for a relation (id, text)."""
    pair = lambda w: f"list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"
    return f"""{name}_w AS (SELECT id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS r, {sql_tokens('text')} AS f FROM {of}),
{name}_t AS (SELECT id, md5(t) AS h FROM (SELECT id, unnest(list_concat(list_distinct(list_concat(r, f)), {pair('r')}, {pair('f')})) AS t FROM {name}_w)),
{name}_n AS (SELECT id, ('0x' || h[31:32])::INT AS a, list_sum(list_transform(string_split(h, ''), lambda c: instr('123456789abcdef', c)))::INT % 3 AS b, ('0x' || h[28:28])::INT AS c FROM {name}_t),
{name}_v AS (SELECT id, a + 256 * (((b - a) % 3 + 3) % 3) AS idx, sum(CASE WHEN c % 2 = 1 THEN -1 ELSE 1 END)::DOUBLE AS v FROM {name}_n GROUP BY 1, 2),
{name} AS (SELECT id, idx, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM {name}_v WHERE v <> 0)"""


def hybrid(spark: SparkSession, d: str, k: int = 20, limit: int = 10) -> DataFrame:
    """(qid, id, score, kind, rank, lex_rank, vec_rank): words and hashed vectors fused by reciprocal ranks.

    The word leg: field of work 150 (title) and 80 (text), phrase as typed or written out 100 or 50, each word 15 and
    twice its length (title) or 5 and its length (text), institutional kinds 25 beside another hit. The vector leg:
    cosine of 0.3 or more over title and whole text; inside a field of work every positive one with a word hit.
    """
    c = F.col
    docs, wanted = searchable(spark, d), specs(spark, SEARCHES)
    some = lambda a, of: F.exists(c(a), lambda w: c(of).contains(w))
    rows = docs.crossJoin(F.broadcast(wanted)).withColumns({"dt": some("terms", "t"), "dx": some("terms", "x")}).where((F.size("terms") == 0) | c("dt") | c("dx"))
    phrase = lambda of: c(of).contains(c("q")) | c(of).contains(c("full"))
    each = F.aggregate("words", F.lit(0), lambda s, w: s + F.when(c("t").contains(w), 15 + 2 * F.length(w)).when(c("x").contains(w), 5 + F.length(w)).otherwise(0))
    lex = F.when(c("dt"), 150).otherwise(0) + F.when(c("dx"), 80).otherwise(0) + F.when(phrase("t"), 100).when(phrase("x"), 50).otherwise(0) + each
    rows = rows.withColumn("lex", lex).withColumn("lex", c("lex") + F.when((c("lex") > 0) & c("inst") & c("plain"), 25).otherwise(0))
    legs = stage(rows.select("qid", "id", "created_at", "lex", (F.size("terms") > 0).alias("gated")))
    vectors = hashed_vectors(doc_index(spark, d).select("id", F.concat_ws(" ", "title", "body").alias("text")))
    mine = hashed_vectors(spark.createDataFrame([(str(k_), q) for k_, q in SEARCHES.items()], "id string, text string")).select(c("id").cast("int").alias("qid"), "idx", c("v").alias("w"))
    dots = vectors.join(F.broadcast(mine), "idx").groupBy("qid", "id").agg(F.round(F.sum(c("v") * c("w")), 6).alias("dot"))
    near = dots.join(legs, ["qid", "id"]).where(F.when(c("gated"), (c("lex") > 0) & (c("dot") > 0)).otherwise(c("dot") >= 0.3))
    rank = lambda *by: F.row_number().over(Window.partitionBy("qid").orderBy(*by))
    a = legs.where("lex > 0").select("qid", "id", "lex", rank(F.desc("lex"), F.desc("created_at"), "id").alias("lex_rank"))
    b = near.select("qid", "id", "dot", rank(F.desc("dot"), F.desc("created_at"), "id").alias("vec_rank"))
    one = lambda x: F.coalesce(1 / (k + c(x)), F.lit(0.0))
    kind = F.when(c("lex").isNotNull() & c("dot").isNotNull(), "HYBRID_BOTH").when(c("lex").isNotNull(), "KEYWORD_ONLY").otherwise("SEMANTIC_ONLY")
    fused = a.join(b, ["qid", "id"], "full_outer").withColumns({"score": F.round(one("lex_rank") + one("vec_rank"), 8), "kind": kind, "tie": F.coalesce(c("lex"), F.lit(0)) + 100 * F.coalesce(c("dot"), F.lit(0.0))})
    return top(fused, "qid", limit, F.desc("score"), F.desc(F.round("tie", 3)), F.asc("id")).select("qid", "id", "score", "kind", "rank", "lex_rank", "vec_rank")


def _hybrid_sql() -> str:
    some = lambda a, of: f"len(list_filter({a}, lambda w: contains({of}, w))) > 0"
    phrase = lambda of: f"contains({of}, q) OR contains({of}, full_)"
    each = "coalesce(list_sum(list_transform(words, lambda w: CASE WHEN contains(t, w) THEN 15 + 2 * length(w) WHEN contains(x, w) THEN 5 + length(w) ELSE 0 END)), 0)::BIGINT"
    queries = ", ".join(f"({k}, '{q}')" for k, q in SEARCHES.items())
    return f"""WITH {IDX}, {_DOCS_SQL}, {_specs_sql(SEARCHES)}, g AS (SELECT *, {some('terms', 't')} AS dt, {some('terms', 'x')} AS dx FROM docs, spec),
l0 AS (SELECT *, CASE WHEN dt THEN 150 ELSE 0 END + CASE WHEN dx THEN 80 ELSE 0 END + CASE WHEN {phrase('t')} THEN 100 WHEN {phrase('x')} THEN 50 ELSE 0 END + {each} AS l FROM g WHERE len(terms) = 0 OR dt OR dx),
legs AS (SELECT qid, id, created_at, len(terms) > 0 AS gated, l + CASE WHEN l > 0 AND inst AND plain THEN 25 ELSE 0 END AS lex FROM l0),
dt_ AS (SELECT id, concat_ws(' ', title, body) AS text FROM idx), {_vectors_sql('dv', 'dt_')}, qt_ AS (SELECT * FROM (VALUES {queries}) v(id, text)), {_vectors_sql('qv', 'qt_')},
dots AS (SELECT qv.id AS qid, dv.id, round(sum(dv.v * qv.v), 6) AS dot FROM dv JOIN qv USING (idx) GROUP BY 1, 2),
near_ AS (SELECT qid, id, dot, created_at FROM dots JOIN legs USING (qid, id) WHERE CASE WHEN gated THEN lex > 0 AND dot > 0 ELSE dot >= 0.3 END),
a AS (SELECT qid, id, lex, row_number() OVER (PARTITION BY qid ORDER BY lex DESC, created_at DESC, id) AS lex_rank FROM legs WHERE lex > 0), b AS (SELECT qid, id, dot, row_number() OVER (PARTITION BY qid ORDER BY dot DESC, created_at DESC, id) AS vec_rank FROM near_),
f AS (SELECT qid, id, lex_rank, vec_rank, round(coalesce(1.0::DOUBLE / (20 + lex_rank), 0) + coalesce(1.0::DOUBLE / (20 + vec_rank), 0), 8) AS score, CASE WHEN lex IS NOT NULL AND dot IS NOT NULL THEN 'HYBRID_BOTH' WHEN lex IS NOT NULL THEN 'KEYWORD_ONLY' ELSE 'SEMANTIC_ONLY' END AS kind, coalesce(lex, 0) + 100 * coalesce(dot, 0) AS tie FROM a FULL JOIN b USING (qid, id))
SELECT qid, id, score, kind, rank, lex_rank, vec_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, round(tie, 3) DESC, id) AS rank FROM f) WHERE rank <= 10"""


#: Searched fields with their boosts, of single words and of the whole phrase.
FIELDS = {"title": (3.0, 5.0), "body": (2.0, 2.5), "student_name": (2.5, 4.0), "student_id": (3.0, 0.0), "document_number": (2.0, 0.0), "category_name": (1.5, 0.0), "tags": (2.0, 0.0)}
PHRASE = 2.5


def synonyms_of(q: str) -> list[str]:
    """The folded words of a query and, for every group that one of its terms stands in, the words of the group."""
    plain = folded(q)
    out = plain.split()
    for group in SYNONYMS:
        terms = group.split(",")
        if any(f" {t} " in f" {plain} " for t in terms):
            out += [w for t in terms for w in t.split()]
    return list(dict.fromkeys(out))


def boosted(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """(qid, id, score, rank): BM25 of the query's words and their synonyms in each field, boosted, of the best field; a phrase adds its own."""
    c = F.col
    i = doc_index(spark, d).withColumn("tags", F.array_join("tags", " "))
    long = i.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(c(f), F.lit("")).alias("text"), F.lit(w).alias("boost"), F.lit(p).alias("pboost")) for f, (w, p) in FIELDS.items()])).alias("s")).select("id", "s.*")
    words = stage(long.withColumn("w", tokens("text")).drop("text"))
    stats = words.groupBy("field").agg(F.count_if(F.size("w") > 0).alias("n"), F.avg(F.when(F.size("w") > 0, F.size("w"))).alias("avgdl"))
    terms = spark.createDataFrame([(q, t) for q, text in SEARCHES.items() for t in synonyms_of(text)], "qid int, term string")
    post = words.withColumn("dl", F.size("w")).select("id", "field", "boost", "dl", F.explode("w").alias("term")).join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    post = post.groupBy("id", "field", "boost", "term").agg(N(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    df = post.groupBy("field", "term").agg(N(F.lit(1)).alias("df"))
    rare = df.join(stats, "field").withColumn("idf", F.log(1 + (c("n") - c("df") + 0.5) / (c("df") + 0.5)))
    sat = lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / c("avgdl")))
    hits = post.join(F.broadcast(rare), ["field", "term"]).join(F.broadcast(terms), "term").groupBy("qid", "id", "field").agg((F.first("boost") * F.sum(c("idf") * sat(c("tf"), c("dl")))).alias("s"))
    best = hits.groupBy("qid", "id").agg(F.max("s").alias("s"))
    phrases = spark.createDataFrame([(q, f" {' '.join(folded(text).split())} ", folded(text).split()) for q, text in SEARCHES.items() if " " in folded(text)], "qid int, phrase string, parts array<string>")
    weight = phrases.select("qid", F.explode("parts").alias("term")).join(rare, "term").groupBy("qid", "field").agg(F.sum("idf").alias("idf"))
    line = F.concat(F.lit(" "), F.array_join("w", "  "), F.lit(" "))
    wanted = F.regexp_replace("phrase", r"(?<=\S) (?=\S)", "  ")
    met = words.where("pboost > 0").crossJoin(F.broadcast(phrases.select("qid", wanted.alias("phrase")))).withColumn("tf", ((F.length(line) - F.length(F.replace(line, c("phrase"), F.lit("")))) / F.length("phrase")).cast("int")).where("tf > 0")
    extra = met.join(F.broadcast(weight), ["qid", "field"]).join(F.broadcast(stats), "field").groupBy("qid", "id").agg(F.sum(PHRASE * c("pboost") * c("idf") * sat(c("tf"), F.size("w"))).alias("p"))
    total = best.join(extra, ["qid", "id"], "left").select("qid", "id", F.round(c("s") + F.coalesce("p", F.lit(0.0)), 5).alias("score"))
    return top(total, "qid", k, F.desc("score"), F.asc("id"))


def _boosted_sql() -> str:
    legs = " UNION ALL ".join(f"SELECT id, '{f}' AS field, {sql_tokens(f'coalesce({x}, {chr(39)}{chr(39)})')} AS w, {b}::DOUBLE AS boost, {p}::DOUBLE AS pboost FROM idx" for f, (b, p) in FIELDS.items() for x in [f if f != "tags" else "array_to_string(tags, ' ')"])
    terms = ", ".join(f"({q}, '{t}')" for q, text in SEARCHES.items() for t in synonyms_of(text))
    phrases = ", ".join(f"({q}, ' {'  '.join(folded(text).split())} ', {_lit(folded(text).split())})" for q, text in SEARCHES.items() if " " in folded(text))
    sat = lambda tf, dl: f"{tf} * {K1 + 1} / ({tf} + {K1} * (1 - {B} + {B} * {dl} / avgdl))"
    return f"""WITH {IDX}, words AS ({legs}), stats AS (SELECT field, count(*) FILTER (len(w) > 0) AS n, avg(len(w)) FILTER (len(w) > 0) AS avgdl FROM words GROUP BY field), terms AS (SELECT * FROM (VALUES {terms}) v(qid, term)),
post AS (SELECT id, field, boost, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, field, boost, len(w) AS dl, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM terms) GROUP BY 1, 2, 3, 4),
rare AS (SELECT field, term, n, avgdl, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT field, term, count(*) AS df FROM post GROUP BY 1, 2) JOIN stats USING (field)),
hits AS (SELECT qid, id, field, any_value(boost) * sum(idf * {sat('tf', 'dl')}) AS s FROM post JOIN rare USING (field, term) JOIN terms USING (term) GROUP BY 1, 2, 3), best AS (SELECT qid, id, max(s) AS s FROM hits GROUP BY 1, 2),
phrases AS (SELECT * FROM (VALUES {phrases}) v(qid, phrase, parts)), weight AS (SELECT qid, field, sum(idf) AS idf FROM (SELECT qid, unnest(parts) AS term FROM phrases) JOIN rare USING (term) GROUP BY 1, 2),
met AS (SELECT qid, id, field, pboost, len(w) AS dl, ((length(line) - length(replace(line, phrase, ''))) / length(phrase))::INT AS tf FROM (SELECT *, ' ' || array_to_string(w, '  ') || ' ' AS line FROM words WHERE pboost > 0), phrases),
extra AS (SELECT qid, id, sum({PHRASE} * pboost * idf * {sat('tf', 'dl')}) AS p FROM met JOIN weight USING (qid, field) JOIN stats USING (field) WHERE tf > 0 GROUP BY 1, 2)
SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, id, round(s + coalesce(p, 0), 5) AS score FROM best LEFT JOIN extra USING (qid, id))) WHERE rank <= 10"""


def any_accent(term: str) -> str:
    """A pattern for a term with any accents on its letters."""
    of: dict[str, str] = {}
    for a, b in zip(_SRC, _DST):
        of[b.lower()] = of.get(b.lower(), "") + a
    return "".join(f"[{c}{of.get(c, '')}]" if c in of else ("\\s+" if c == " " else "\\" + c if not c.isalnum() else c) for c in folded(term))


MARKED = ("hoc bong", "thu vien", "bao hiem")
_MARKS = "(?i)(" + "|".join(any_accent(t) for t in sorted(MARKED, key=len, reverse=True)) + ")"


def marked(spark: SparkSession, d: str) -> DataFrame:
    """(id, n, text_md5): whole texts with every hit of several terms marked whatever its accents; marks that were there are taken out first."""
    bare = F.regexp_replace("body", "</?em>", "")
    docs = doc_index(spark, d).where("body is not null").withColumn("n", F.regexp_count(bare, F.lit(_MARKS))).where("n > 0")
    return docs.select("id", "n", F.md5(F.regexp_replace(bare, _MARKS, "<em>$1</em>")).alias("text_md5"))


MARKED_SQL = f"WITH {IDX}, b AS (SELECT id, regexp_replace(body, '</?em>', '', 'g') AS b FROM idx WHERE body IS NOT NULL) SELECT id, len(regexp_extract_all(b, '{_MARKS}'))::INT AS n, md5(regexp_replace(b, '{_MARKS}', '<em>\\1</em>', 'g')) AS text_md5 FROM b WHERE regexp_matches(b, '{_MARKS}')"


def snippets(spark: SparkSession, d: str, term: str = "hoc bong") -> DataFrame:
    """(id, snippet): fifty characters before the first hit to 220 after, with dots where text was left out; found on the folded text of equal length."""
    plain = F.lower(F.translate("body", _SRC, _DST))
    at = F.instr(plain, term)
    start = F.greatest(at - 50, F.lit(1))
    cut = F.substring(F.col("body"), start, at + 220 - start)
    docs = doc_index(spark, d).where(at > 0)
    return docs.select("id", F.concat(F.when(start > 1, "...").otherwise(""), cut, F.when(at + 220 <= F.length("body"), "...").otherwise("")).alias("snippet"))


SNIPPET_SQL = f"WITH {IDX}, p AS (SELECT id, body, instr(lower(translate(body, '{_SRC}', '{_DST}')), 'hoc bong') AS pos FROM idx WHERE body IS NOT NULL), s AS (SELECT *, greatest(pos - 50, 1) AS a FROM p WHERE pos > 0) SELECT id, CASE WHEN a > 1 THEN '...' ELSE '' END || substring(body, a, pos + 220 - a) || CASE WHEN pos + 220 <= length(body) THEN '...' ELSE '' END AS snippet FROM s"


def best_sentences(spark: SparkSession, d: str) -> DataFrame:
    """(id, place, rank, hits): the two sentences of each text with the most hits."""
    s = doc_index(spark, d).where("body is not null").select("id", F.posexplode(F.split("body", r"[.!?]\s+")).alias("place", "sentence")).withColumn("hits", F.regexp_count("sentence", F.lit(_MARKS))).where("hits > 0")
    return top(s, "id", 2, F.desc("hits"), F.asc("place")).select("id", "place", "rank", "hits")


SENTENCES_SQL = f"WITH {IDX}, s AS (SELECT id, generate_subscripts(p, 1) - 1 AS place, unnest(p) AS sentence FROM (SELECT id, regexp_split_to_array(body, '[.!?]\\s+') AS p FROM idx WHERE body IS NOT NULL)), h AS (SELECT id, place::INT AS place, len(regexp_extract_all(sentence, '{_MARKS}'))::INT AS hits FROM s) SELECT * FROM (SELECT id, place, hits, row_number() OVER (PARTITION BY id ORDER BY hits DESC, place) AS rank FROM h WHERE hits > 0) WHERE rank <= 2"

TYPED = {1: "hcc bong", 2: "thu vein", 3: "bao heim y te", 4: "ke hoahc", 5: "scholarshp budgt"}


def did_you_mean(spark: SparkSession, d: str) -> DataFrame:
    """(qid, word, better, df): for each word of a query the most frequent title word within two edits and with its first letter, if more frequent."""
    vocab = doc_index(spark, d).select("id", F.explode(F.array_distinct(tokens("title"))).alias("term")).groupBy("term").agg(N(F.lit(1)).alias("df"))
    vocab = stage(vocab.where(F.length("term") > 1))
    typed = spark.createDataFrame([(k, w) for k, q in TYPED.items() for w in q.split()], "qid int, word string")
    own = typed.join(vocab.toDF("word", "own"), "word", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    most = F.when(F.length("word") <= 2, 0).when(F.length("word") <= 4, 1).otherwise(2)
    met = vocab.join(F.broadcast(own), F.substring("term", 1, 1) == F.substring("word", 1, 1)).where((F.col("df") > F.col("own")) & (F.levenshtein("word", "term") <= most))
    return top(met, "word", 1, F.levenshtein("word", "term"), F.desc("df"), F.asc("term")).select("qid", "word", F.col("term").alias("better"), "df")


MEAN_SQL = f"WITH {IDX}, vocab AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest({sql_tokens('title')}) AS term FROM idx) WHERE length(term) > 1 GROUP BY term), typed AS (SELECT * FROM (VALUES {', '.join(f'({k}, {chr(39)}{w}{chr(39)})' for k, q in TYPED.items() for w in q.split())}) v(qid, word)), own AS (SELECT qid, word, coalesce(df, 0) AS own FROM typed LEFT JOIN vocab ON word = term) SELECT qid, word, term AS better, df FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY levenshtein(word, term), df DESC, term) AS k FROM own JOIN vocab ON word[1] = term[1] AND df > own AND levenshtein(word, term) <= CASE WHEN length(word) <= 2 THEN 0 WHEN length(word) <= 4 THEN 1 ELSE 2 END) WHERE k = 1"


def tolerant(spark: SparkSession, d: str, q: str = "hb k|<ht l0 nam 202O") -> DataFrame:
    """(id, n): documents that hold the words of a query typed off a scan, after its misreadings are mended and abbreviations written out."""
    wanted = [w for w in folded(corrected(q)).split() if w.isalnum() and len(w) > 2]
    n = reduce(lambda a, b: a + b, [F.array_contains("xt", w).cast("int") for w in wanted])
    return searchable(spark, d).withColumn("n", n).where("n >= 3").select("id", "n")


TOLERANT_SQL = f"WITH {IDX}, {_DOCS_SQL} SELECT id, n FROM (SELECT id, {' + '.join(f'list_contains(xt, {chr(39)}{w}{chr(39)})::INT' for w in folded(corrected('hb k|<ht l0 nam 202O')).split() if w.isalnum() and len(w) > 2)} AS n FROM docs) WHERE n >= 3"

_INTENTS = [("mghp", "TUITION"), ("kkht", "SCHOLARSHIP"), ("hoc bong", "SCHOLARSHIP"), ("ky tuc", "HOUSING"), ("bao hiem", "INSURANCE"), ("vay von", "LOAN"), ("bao luu", "PAUSE"), ("kinh phi", "BUDGET"), ("thi", "EXAM")]


def intents(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, intent): each evaluation text by the first notion that it holds."""
    from scrivan.sources.tables import load

    x = fold("text")
    case = reduce(lambda a, b: a.when(x.contains(b[0]), b[1]), _INTENTS[1:], F.when(x.contains(_INTENTS[0][0]), _INTENTS[0][1]))
    return load(spark, d, "eval_items").select("item_id", F.coalesce(case, F.lit("NONE")).alias("intent"))


INTENT_SQL = f"SELECT item_id, CASE {' '.join(f'WHEN contains(x, {chr(39)}{k}{chr(39)}) THEN {chr(39)}{v}{chr(39)}' for k, v in _INTENTS)} ELSE 'NONE' END AS intent FROM (SELECT item_id, {sql_fold('text')} AS x FROM eval_items)"

CATALOG = {
    "search_rules_all": (rules, RULES_SQL), "search_hybrid_rrf": (hybrid, _hybrid_sql()), "search_boosted_fields": (boosted, _boosted_sql()), "search_marked_terms": (marked, MARKED_SQL),
    "search_snippets": (snippets, SNIPPET_SQL), "search_best_sentences": (best_sentences, SENTENCES_SQL), "search_did_you_mean": (did_you_mean, MEAN_SQL), "search_scan_tolerant": (tolerant, TOLERANT_SQL), "query_intents": (intents, INTENT_SQL),
}
