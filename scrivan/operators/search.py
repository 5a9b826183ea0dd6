"""Ranked search: BM25 over postings, a rule scorer, fuzzy terms, suggestions, similar documents, rank fusion."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivan.functions.text import cosine, fold, jaccard, shingles, tokens
from scrivan.operators.index import SQL as IDX
from scrivan.operators.index import doc_index, sql_fold, sql_tokens
from scrivan.runtime import stage
from scrivan.sources.tables import load

K1, B = 1.2, 0.75
#: Best words of the sources of similar documents that are sent to the tasks at once; scores that a task holds at once.
MOST_TERMS, CELLS = 300_000, 4_000_000
QUERIES = {1: "học bổng khuyến khích", 2: "quyết định kỷ luật", 3: "scholarship budget", 4: "thư viện trung tâm", 5: "ky tuc xa mua he"}


def query_terms(spark: SparkSession, queries: dict[int, str] | None = None) -> DataFrame:
    """(qid, term): the folded words of each query."""
    rows = spark.createDataFrame(list((queries or QUERIES).items()), "qid int, q string")
    return rows.select("qid", F.explode(F.array_distinct(tokens("q"))).alias("term"))


def postings(docs: DataFrame, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, term, tf, dl) of docs (id, text), for the given terms only, and one row (n, avgdl)."""
    words = docs.select("id", tokens(F.coalesce("text", F.lit(""))).alias("w")).withColumn("dl", F.size("w"))
    if terms is not None:  # the queries' words, a handful: one pass keeps lengths and these words, and everything below reads that
        wanted = F.array(*[F.lit(r.term) for r in terms.select("term").distinct().collect()])
        words = stage(words.select("id", "dl", F.filter("w", lambda t: F.array_contains(wanted, t)).alias("w")))
    stats = words.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    flat = words.select("id", "dl", F.explode("w").alias("term"))
    return flat.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl")), stats


def bm25(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, id, score): the sum over a query's words of idf and saturated frequency."""
    post, stats = postings(docs, terms)
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hits = post.join(F.broadcast(df), "term").join(F.broadcast(terms), "term").crossJoin(F.broadcast(stats))
    return hits.groupBy("qid", "id").agg(F.sum(part).alias("score"))


def top(df: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def search_docs(spark: SparkSession, d: str) -> DataFrame:
    return doc_index(spark, d).select("id", F.concat_ws(" ", "title", "body").alias("text"))


def bm25_topk(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    scored = bm25(search_docs(spark, d), query_terms(spark)).withColumn("score", F.round("score", 6))
    return top(scored, "qid", k, F.desc("score"), F.asc("id"))


def _sql_queries() -> str:
    return ", ".join(f"({k}, '{q}')" for k, q in QUERIES.items())


_BM25_SQL = f"""{IDX},
qs AS (SELECT DISTINCT qid, unnest({sql_tokens('q')}) AS term FROM (VALUES {_sql_queries()}) t(qid, q)),
words AS (SELECT id, {sql_tokens("concat_ws(' ', title, body)")} AS w FROM idx),
stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM words),
post AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM qs) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
scored AS (SELECT qid, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * dl / avgdl))) AS s FROM post JOIN df USING (term) JOIN qs USING (term) CROSS JOIN stats GROUP BY qid, id)"""
BM25_SQL = f"WITH {_BM25_SQL} SELECT * FROM (SELECT qid, id, round(s, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, id) AS rank FROM scored) WHERE rank <= 10"

INSTITUTIONAL = ("thong tu", "quyet dinh", "quy dinh", "quy che", "huong dan", "thong bao", "bao cao")


def lexical(spark: SparkSession, d: str, q: str = "học bổng khuyến khích") -> DataFrame:
    """(id, score): the rule scorer for one query, cut off below a share of the best score.

    A whole phrase in the title gives 200 and twice its length, in the text 100; a student or document number in the
    query gives 180 at least; if nothing fits yet, word pairs in the title (130 + 25 each) or text (70 + 15 each), then
    all words in the title (115 + 10 each) or text (55). Unlike the scorer it stands for, a document of an
    institutional kind scores 25 more only beside another hit.
    """
    words = _fold(q).split()
    phrase, pairs = " ".join(words), [" ".join(p) for p in zip(words, words[1:])]
    docs = stage(doc_index(spark, d).select("id", fold(F.coalesce("title", F.lit(""))).alias("t"), fold(F.coalesce("body", F.lit(""))).alias("x"), "student_id", "document_number"))  # folded once
    count = lambda c, parts: reduce(lambda a, b: a + b, [F.col(c).contains(p).cast("int") for p in parts], F.lit(0))
    exact = F.when(F.col("t").contains(phrase), 200 + 2 * len(phrase)).when(F.col("x").contains(phrase), 100).otherwise(0)
    number = F.coalesce((F.length("student_id") > 3) & F.lit(phrase).contains(fold("student_id")), F.lit(False))
    known = F.when(number, F.greatest(exact, F.lit(180))).otherwise(exact)
    nt, nx, wt, wx = count("t", pairs), count("x", pairs), count("t", words), count("x", words)
    loose = (
        F.when(nt > 0, 130 + 25 * nt).when(nx > 0, 70 + 15 * nx).when(wt == len(words), 115 + 10 * wt).when((wt >= 1) & (wx >= len(words) - 1), 75).when(wx == len(words), 55).otherwise(0)
    )
    score = F.when(known > 0, known).otherwise(loose)
    kind = reduce(lambda a, b: a | b, [F.col("t").startswith(p) for p in INSTITUTIONAL])
    scored = stage(docs.select("id", (score + F.when((score > 0) & kind, 25).otherwise(0)).alias("score"))).where("score > 0")
    best = scored.agg(F.max("score").alias("m"))
    floor = F.when(F.col("m") >= 120, F.greatest(0.5 * F.col("m"), F.lit(80.0))).when(F.col("m") >= 70, F.greatest(0.6 * F.col("m"), F.lit(50.0))).otherwise(0.0)
    return scored.crossJoin(F.broadcast(best)).where(F.col("score") >= floor).select("id", "score")


def _fold(q: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", q.lower().replace("đ", "d")) if not unicodedata.combining(c)).strip()


def lexical_sql(q: str = "học bổng khuyến khích") -> str:
    words = _fold(q).split()
    phrase, pairs = " ".join(words), [" ".join(p) for p in zip(words, words[1:])]
    count = lambda c, parts: " + ".join(f"contains({c}, '{p}')::int" for p in parts)
    kind = " OR ".join(f"starts_with(t, '{p}')" for p in INSTITUTIONAL)
    return f"""WITH {IDX}, docs AS (SELECT id, {sql_fold("coalesce(title, '')")} AS t, {sql_fold("coalesce(body, '')")} AS x, {sql_fold('student_id')} AS s FROM idx),
parts AS (SELECT *, CASE WHEN contains(t, '{phrase}') THEN {200 + 2 * len(phrase)} WHEN contains(x, '{phrase}') THEN 100 ELSE 0 END AS e, {count('t', pairs)} AS nt, {count('x', pairs)} AS nx, {count('t', words)} AS wt, {count('x', words)} AS wx FROM docs),
known AS (SELECT *, CASE WHEN coalesce(length(s) > 3 AND contains('{phrase}', s), false) THEN greatest(e, 180) ELSE e END AS k FROM parts),
base AS (SELECT id, t, CASE WHEN k > 0 THEN k WHEN nt > 0 THEN 130 + 25 * nt WHEN nx > 0 THEN 70 + 15 * nx WHEN wt = {len(words)} THEN 115 + 10 * wt WHEN wt >= 1 AND wx >= {len(words) - 1} THEN 75 WHEN wx = {len(words)} THEN 55 ELSE 0 END AS b FROM known),
scored AS (SELECT id, b + CASE WHEN {kind} THEN 25 ELSE 0 END AS score FROM base WHERE b > 0), best AS (SELECT max(score) AS m FROM scored)
SELECT id, score FROM scored, best WHERE score >= CASE WHEN m >= 120 THEN greatest(0.5 * m, 80) WHEN m >= 70 THEN greatest(0.6 * m, 50) ELSE 0 END"""


def fuzzy_terms(spark: SparkSession, d: str, wanted: tuple[str, ...] = ("hoc", "thuong", "budgt", "libary", "khoan")) -> DataFrame:
    """(q, term, n, dist): title words that share two letters with a term and lie within its edit bound (0, 1 or 2 by length)."""
    vocab = doc_index(spark, d).select(F.explode(tokens("title")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    q = spark.createDataFrame([(w,) for w in wanted], "q string")
    bound = F.when(F.length("q") <= 2, 0).when(F.length("q") <= 5, 1).otherwise(2)
    met = vocab.join(F.broadcast(q), F.substring("term", 1, 2) == F.substring("q", 1, 2))
    return met.withColumn("dist", F.levenshtein("q", "term")).where(F.col("dist") <= bound)


FUZZY_SQL = f"""WITH {IDX}, vocab AS (SELECT term, count(*) AS n FROM (SELECT unnest({sql_tokens('title')}) AS term FROM idx) GROUP BY term),
q AS (SELECT * FROM (VALUES ('hoc'), ('thuong'), ('budgt'), ('libary'), ('khoan')) t(q))
SELECT term, n, q, levenshtein(q, term) AS dist FROM vocab JOIN q ON term[1:2] = q[1:2] WHERE levenshtein(q, term) <= CASE WHEN length(q) <= 2 THEN 0 WHEN length(q) <= 5 THEN 1 ELSE 2 END"""


def suggest(spark: SparkSession, d: str, prefix: str = "ke hoach", k: int = 8) -> DataFrame:
    """(title, newest): distinct titles of finished records that contain the folded prefix, newest first."""
    docs = doc_index(spark, d).where(F.col("ocr_status").isin("APPROVED", "DONE") & fold("title").contains(prefix))
    return docs.groupBy("title").agg(F.max("created_at").alias("c")).orderBy(F.desc("c"), "title").limit(k).select("title", F.date_format("c", "yyyy-MM-dd HH:mm:ss").alias("newest"))


SUGGEST_SQL = f"WITH {IDX} SELECT title, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS newest FROM idx WHERE ocr_status IN ('APPROVED', 'DONE') AND contains({sql_fold('title')}, 'ke hoach') GROUP BY title ORDER BY max(created_at) DESC, title LIMIT 8"


def more_like_this(spark: SparkSession, d: str, k_terms: int = 12, k: int = 5) -> DataFrame:
    """``alike`` by titles."""
    return alike(doc_index(spark, d).select("id", F.col("title").alias("text")), k_terms, k)


def more_like_this_texts(spark: SparkSession, d: str, k_terms: int = 12, k: int = 5) -> DataFrame:
    """``alike`` by titles and whole texts."""
    return alike(search_docs(spark, d), k_terms, k)


def alike(docs: DataFrame, k_terms: int, k: int) -> DataFrame:
    """(src, id, score, rank): for every record whose id's first eight digits are divisible by 100, the records that share its best words by tf-idf."""
    words = stage(docs.select("id", tokens(F.coalesce("text", F.lit(""))).alias("w")))
    n = words.agg(F.count(F.lit(1)).alias("n"))
    df = words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.round(F.col("tf") * F.log(F.col("n") / F.col("df")), 6)
    sources = words.where(F.conv(F.substring("id", 1, 8), 16, 10).cast("bigint") % 100 == 0).select(F.col("id").alias("src"), F.explode("w").alias("term")).where(F.length("term") > 1)
    sources = sources.groupBy("src", "term").agg(F.count(F.lit(1)).alias("tf")).join(df, "term").crossJoin(F.broadcast(n)).withColumn("ws", weight)
    best = stage(top(sources, "src", k_terms, F.desc("ws"), F.asc("term")).select("src", "term", "ws", "df", "n"))
    # every task scores its documents against all sources of a turn and keeps what may be among a source's first: no pair is shuffled
    turns = max(1, -(-best.count() // max(1, MOST_TERMS)))
    parts = [_firsts(words, best.where(F.pmod(F.xxhash64("src"), F.lit(turns)) == turn), k) for turn in range(turns)]
    return top(reduce(DataFrame.unionByName, parts), "src", k, F.desc("score"), F.asc("id"))


def _firsts(words: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """(src, id, score): of (id, w) rows those that may be among the first k of a source, by its (src, term, ws, df, n)."""
    told = best.orderBy("src", "term").toArrow()
    shared = words.sparkSession.sparkContext.broadcast(told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks(shared.value, k)
        for batch in batches:
            for start in range(0, batch.num_rows, step := max(1, CELLS // max(1, len(ranks.sources)))):
                yield ranks.of(batch.slice(start, step))

    return words.mapInArrow(run, "src string, id string, score double")


class Ranks:
    """Scores documents, some at a time, against all sources, and remembers the best scores of each."""

    def __init__(self, best: pa.Table, k: int) -> None:
        self.k = k
        src, term = (best[c].combine_chunks().dictionary_encode() for c in ("src", "term"))
        self.sources, self.terms = src.dictionary, term.dictionary
        s, t = src.indices.to_numpy(), term.indices.to_numpy()
        order = np.argsort(t, kind="stable")
        self.src, self.ws = s[order], best["ws"].to_numpy()[order]
        self.count = np.bincount(t, minlength=len(self.terms))
        self.start = np.cumsum(self.count) - self.count
        self.idf = np.zeros(len(self.terms))
        self.idf[t] = np.log(best["n"].to_numpy() / best["df"].to_numpy())
        self.scores = np.full((len(self.sources), k), -1.0)

    def products(self, doc: np.ndarray, term: np.ndarray, w: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The cells of the documents' words in the sources that have them, with their products."""
        ends = np.cumsum(self.count[term])
        low = 0
        while low < len(term):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CELLS, "right")))
            n = self.count[term[low:high]]
            at = np.repeat(self.start[term[low:high]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            yield self.src[at] * size + np.repeat(doc[low:high], n), self.ws[at] * np.repeat(w[low:high], n)
            low = high

    def of(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.take(pc.sort_indices(batch["id"]))  # of equal scores the smaller id comes first
        ids, lists, size = batch["id"], batch["w"], batch.num_rows
        shape = (len(self.sources), size)
        known = pc.index_in(lists.flatten(), value_set=self.terms)
        doc = np.repeat(np.arange(size), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        hit = known.is_valid().to_numpy(zero_copy_only=False)
        pairs, tf = np.unique(doc[hit] * max(1, len(self.terms)) + known.drop_null().to_numpy(), return_counts=True)
        doc, term = np.divmod(pairs, max(1, len(self.terms)))
        w = np.floor(tf * self.idf[term] * 1e6 + 0.5) / 1e6
        # words of many documents and sources by a matrix product, the others by their places
        often = (np.bincount(term, minlength=len(self.terms)) * self.count >= max(1, shape[0] * size // 20)) & (self.count > 0)
        column, dense = np.cumsum(often) - 1, often[term]
        a, b = np.zeros((shape[0], int(often.sum()))), np.zeros((int(often.sum()), size))
        b[column[term[dense]], doc[dense]] = w[dense]
        own = np.repeat(np.arange(len(self.terms)), self.count)
        a[self.src[often[own]], column[own[often[own]]]] = self.ws[often[own]]
        m = a @ b
        for cells, x in self.products(doc[~dense], term[~dense], w[~dense], size):
            m += np.bincount(cells, weights=x, minlength=m.size).reshape(shape)
        m = np.where(m > 0, np.floor(m * 1e4 + 0.5), -1.0)
        for cells, _ in self.products(*(x[w == 0] for x in (doc, term, w)), size):  # a common word without weight is a hit all the same
            m.reshape(-1)[cells] = np.maximum(m.reshape(-1)[cells], 0)
        for cells, x in self.products(doc[w > 0], term[w > 0], w[w > 0], size) if (self.ws == 0).any() else ():
            m.reshape(-1)[cells] = np.maximum(m.reshape(-1)[cells], 0)
        itself = pc.index_in(ids, value_set=self.sources)
        me = np.flatnonzero(itself.is_valid().to_numpy(zero_copy_only=False))
        m[itself.drop_null().to_numpy(), me] = -1
        least = np.maximum(self.scores[:, -1], 0)
        if size > self.k:
            least = np.maximum(least, np.partition(m, size - self.k, axis=1)[:, size - self.k]) if (self.scores[:, -1] < 0).any() else least
        s, d = np.nonzero(m >= least[:, None])
        score = m[s, d]
        order = np.lexsort((d, -score, s))
        s, d, score = s[order], d[order], score[order]
        each = np.bincount(s, minlength=shape[0])
        place = np.arange(len(s)) - np.repeat(np.cumsum(each) - each, each)
        s, d, score, place = (x[place < self.k] for x in (s, d, score, place))
        new = np.full((shape[0], self.k), -1.0)
        new[s, place] = score
        self.scores = -np.sort(-np.concatenate([self.scores, new], axis=1), axis=1)[:, : self.k]
        keep = score >= self.scores[s, -1]
        return pa.RecordBatch.from_arrays([self.sources.take(pa.array(s[keep])), ids.take(pa.array(d[keep])), pa.array(score[keep] / 1e4)], names=["src", "id", "score"])



MLT_SQL = f"""WITH {IDX}, words AS (SELECT id, {sql_tokens('title')} AS w FROM idx), n AS (SELECT count(*) AS n FROM words),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM words) GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
weighed AS (SELECT id, term, round(tf * ln(n / df), 6) AS w FROM post JOIN df USING (term), n WHERE length(term) > 1),
best AS (SELECT id AS src, term, w AS ws FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, term) AS r FROM weighed WHERE ('0x' || id[1:8])::BIGINT % 100 = 0) WHERE r <= 12),
hits AS (SELECT src, id, round(sum(ws * w), 4) AS score FROM weighed JOIN best USING (term) WHERE src <> id GROUP BY src, id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, id) AS rank FROM hits) WHERE rank <= 5"""

#: The same over titles and whole texts.
MLT_TEXTS_SQL = MLT_SQL.replace(sql_tokens("title"), sql_tokens("concat_ws(' ', title, body)"))


def duplicate_scores(spark: SparkSession, d: str) -> DataFrame:
    """(a, b, score, level): records of one title prefix (its number and date) by 0.4 word and 0.6 word-pair similarity."""
    t = doc_index(spark, d).where("title is not null").select("id", tokens("title").alias("w"))
    t = t.withColumn("p", shingles(F.col("w"), 2)).withColumn("key", F.concat_ws(" ", F.slice("w", 1, 5)))
    a, b = t.toDF("a", "wa", "pa", "key"), t.toDF("b", "wb", "pb", "key")
    score = F.when((F.size("pa") == 0) | (F.size("pb") == 0), jaccard(F.col("wa"), F.col("wb"))).otherwise(0.4 * jaccard(F.col("wa"), F.col("wb")) + 0.6 * jaccard(F.col("pa"), F.col("pb")))
    out = a.join(b, "key").where("a < b").select("a", "b", F.round(score, 4).alias("score"))
    return out.where("score >= 0.3").withColumn("level", F.when(F.col("score") >= 0.85, "CRITICAL").when(F.col("score") >= 0.65, "WARNING").otherwise("LOW"))


DUP_SQL = f"""WITH {IDX}, t AS (SELECT id, {sql_tokens('title')} AS w FROM idx WHERE title IS NOT NULL),
s AS (SELECT id, w, array_to_string(w[1:5], ' ') AS key, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS p FROM t),
j AS (SELECT a.id AS a, b.id AS b, a.p AS pa, b.p AS pb, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS jw,
  len(list_intersect(a.p, b.p)) / nullif(len(list_distinct(list_concat(a.p, b.p))), 0) AS jp FROM s a JOIN s b ON a.key = b.key AND a.id < b.id),
o AS (SELECT a, b, round(CASE WHEN len(pa) = 0 OR len(pb) = 0 THEN jw ELSE 0.4 * jw + 0.6 * jp END, 4) AS score FROM j)
SELECT a, b, score, CASE WHEN score >= 0.85 THEN 'CRITICAL' WHEN score >= 0.65 THEN 'WARNING' ELSE 'LOW' END AS level FROM o WHERE score >= 0.3"""


def cosine_topk(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    """(q, vec_id, sim, rank): exact nearest vectors of the vectors with ids divisible by 100."""
    v = load(spark, d, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("e"))
    sims = v.join(F.broadcast(q), F.col("q") != F.col("vec_id")).select("q", "vec_id", F.round(cosine(F.col("e"), F.col("embedding")), 6).alias("sim"))
    return top(sims, "q", k, F.desc("sim"), F.asc("vec_id"))


COSINE_SQL = """WITH s AS (SELECT a.vec_id AS q, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


def rrf(spark: SparkSession, d: str, k: int = 20, limit: int = 10) -> DataFrame:
    """(qid, id, score, kind, rank): BM25 over everything fused with the share of query words in the title, by reciprocal ranks."""
    terms = query_terms(spark)
    a = bm25(search_docs(spark, d), terms).withColumn("score", F.round("score", 6))
    a = top(a, "qid", 50, F.desc("score"), F.asc("id")).select("qid", "id", F.col("rank").alias("ra"))
    size = terms.groupBy("qid").agg(F.count(F.lit(1)).alias("m"))
    t = doc_index(spark, d).select("id", F.explode(F.array_distinct(tokens("title"))).alias("term"))
    b = t.join(F.broadcast(terms), "term").groupBy("qid", "id").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(size), "qid").withColumn("s", F.col("c") / F.col("m"))
    b = top(b.where("s >= 0.3"), "qid", 50, F.desc("s"), F.asc("id")).select("qid", "id", F.col("rank").alias("rb"))
    one = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    kind = F.when(F.col("ra").isNotNull() & F.col("rb").isNotNull(), "BOTH").when(F.col("ra").isNotNull(), "TEXT").otherwise("TITLE")
    fused = a.join(b, ["qid", "id"], "full_outer").select("qid", "id", F.round(one("ra") + one("rb"), 8).alias("score"), kind.alias("kind"))
    return top(fused, "qid", limit, F.desc("score"), F.asc("id"))


RRF_SQL = f"""WITH {_BM25_SQL}, a AS (SELECT * FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, id) AS ra FROM scored) WHERE ra <= 50),
m AS (SELECT qid, count(*) AS m FROM qs GROUP BY qid), t AS (SELECT DISTINCT id, unnest({sql_tokens('title')}) AS term FROM idx),
bs AS (SELECT qid, id, count(*) / any_value(m) AS s FROM t JOIN qs USING (term) JOIN m USING (qid) GROUP BY qid, id),
b AS (SELECT * FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rb FROM bs WHERE s >= 0.3) WHERE rb <= 50),
f AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, round(coalesce(1.0::DOUBLE / (20 + ra), 0) + coalesce(1.0::DOUBLE / (20 + rb), 0), 8) AS score,
  CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN 'BOTH' WHEN ra IS NOT NULL THEN 'TEXT' ELSE 'TITLE' END AS kind FROM a FULL JOIN b ON a.qid = b.qid AND a.id = b.id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10"""

CONCEPTS = {"scholarship": 2.5, "tuition": 2.0, "budget": 1.5, "hoc bong": 2.5, "hoc phi": 2.0, "kinh phi": 1.5, "tro cap": 1.0}


def sparse_expansion(spark: SparkSession, d: str) -> DataFrame:
    """(id, score): weighted related terms of one concept, summed over the terms a text contains."""
    docs = doc_index(spark, d).select("id", fold(F.concat_ws(" ", "title", "body")).alias("x"))
    score = reduce(lambda a, b: a + b, [F.when(F.col("x").contains(t), 2.5 * w).otherwise(0.0) for t, w in CONCEPTS.items()])
    return docs.select("id", F.round(score, 3).alias("score")).where("score > 0")


EXPANSION_SQL = f"WITH {IDX}, x AS (SELECT id, {sql_fold(chr(39).join(['concat_ws(', ' ', ', title, body)']))} AS x FROM idx) SELECT id, score FROM (SELECT id, round({' + '.join(f'CASE WHEN contains(x, {chr(39)}{t}{chr(39)}) THEN {2.5 * w} ELSE 0 END' for t, w in CONCEPTS.items())}, 3)::DOUBLE AS score FROM x) WHERE score > 0"


def highlight(spark: SparkSession, d: str, word: str = "học bổng") -> DataFrame:
    """(id, snippet): the stretch of the text about the first hit, each hit marked."""
    at = F.instr(F.lower("body"), word)
    cut = F.substring(F.col("body"), F.greatest(at - 30, F.lit(1)), F.lit(120))
    docs = doc_index(spark, d).where(at > 0)
    return docs.select("id", F.regexp_replace(cut, f"(?i)({word})", "<em>$1</em>").alias("snippet"))


HIGHLIGHT_SQL = f"WITH {IDX} SELECT id, regexp_replace(substring(body, greatest(instr(lower(body), 'học bổng') - 30, 1)::BIGINT, 120), '(?i)(học bổng)', '<em>\\1</em>', 'g') AS snippet FROM idx WHERE instr(lower(body), 'học bổng') > 0"

CATALOG = {
    "search_bm25_topk": (bm25_topk, BM25_SQL),
    "search_lexical_score": (lexical, lexical_sql()),
    "search_fuzzy_terms": (fuzzy_terms, FUZZY_SQL),
    "search_suggest": (suggest, SUGGEST_SQL),
    "search_more_like_this": (more_like_this, MLT_SQL),
    "search_more_like_this_texts": (more_like_this_texts, MLT_TEXTS_SQL),
    "search_duplicate_check": (duplicate_scores, DUP_SQL),
    "search_cosine_topk": (cosine_topk, COSINE_SQL),
    "search_rrf_fusion": (rrf, RRF_SQL),
    "search_sparse_expansion": (sparse_expansion, EXPANSION_SQL),
    "search_highlight": (highlight, HIGHLIGHT_SQL),
}
