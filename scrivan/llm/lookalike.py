"""One consistent form for text that looks the same: code points, mapping tables, canonical order, recomposition.

Text is cut at plain blanks and line ends. Only pieces with a code point that some mapping changes can change (every
other piece maps to itself), so the distinct ones among these are exploded to positioned code points, joined with the
broadcast decomposition and look-alike tables (bounded: they are made from a fixed part of Unicode), ordered by
combining class within each letter, recomposed by a join with the composition table, and built into strings again. The
result is a dictionary of pieces that is joined back to the texts that hold them.

Look-alike letters change only inside a run of letters that also has a plain Latin one, so whole words in another
script and single symbols stay. Soft hyphens and other invisible characters are removed; other spaces become the plain
one; full-width forms become their ordinary ones; the composed form (NFC) is the usual one.

Cases: null stays null, empty stays empty; texts of any length and repeated rows are handled like all others; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivan.runtime import stage

# Letters of other scripts or of no usual alphabet that look like a usual one, with that one.
_OTHERS = dict(
    zip(
        "аеорсухіјѕһԁԛԝкАВЕКМНОРСТУХІЈЅҺԚԜ" "αονικρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "օսհոՍՏ" "ᎪᏴᏟᎠᎬᎻᎥᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ" "ɡɑıɩʏɪᴏᴄᴠᴡᴢꜱѵðÐƉɖ",
        "aeopcyxijshdqwkABEKMHOPCTYXIJSHQW" "aovikpuABEZHIKMNOPTYX" "ouhnUS" "ABCDEHIJKLMPRSTVWZ" "gaiiyiocvwzsvđĐĐđ",
    )
)
_PLANES = [(0x80, 0x10000), (0x1D000, 0x1D800), (0xE0000, 0xE0200)]
_MARKS = [(0x300, 0x370), (0x1AB0, 0x1B00), (0x1DC0, 0x1E00), (0x20D0, 0x2100), (0xFE20, 0xFE30)]


def _styled() -> dict[str, str]:
    """Letters that Unicode itself gives as a styled form (mathematical, script, roman numeral) of one ASCII letter."""
    out = {}
    for low, high in _PLANES:
        for cp in range(low, high):
            ch = chr(cp)
            if not 0xFF00 <= cp < 0xFF60 and unicodedata.decomposition(ch)[:1] == "<" and unicodedata.category(ch) in ("Lu", "Ll", "Nl"):
                plain = unicodedata.normalize("NFKC", ch)
                if len(plain) == 1 and plain.isascii() and plain.isalpha():
                    out[ch] = plain
    return out


LOOK_ALIKE = _OTHERS | _styled()


def _mapping_rows() -> tuple[list[tuple], list[tuple], str]:
    """Decompositions (char, parts, kind), compositions (parts, char) and the characters that some mapping changes."""
    parts, composed = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x212A, 0x212C)]:
        ch = chr(cp)
        whole = unicodedata.normalize("NFD", ch)
        if whole != ch and ch not in LOOK_ALIKE:
            parts.append((ch, list(whole), "singleton" if unicodedata.normalize("NFC", ch) != ch else None))
            if unicodedata.normalize("NFC", whole) == ch:
                composed.append((whole, ch))
    changing = [0x212A, 0x212B, *(cp for low, high in _MARKS for cp in range(low, high)), *map(ord, LOOK_ALIKE)]
    for cp in [*range(0xFF01, 0xFF5F), *range(0xFFE0, 0xFFE7)]:
        parts.append((chr(cp), list(unicodedata.normalize("NFKC", chr(cp))), "full_width"))
        changing.append(cp)
    for low, high in _PLANES:
        for cp in range(low, high):
            kind = unicodedata.category(chr(cp))
            if kind in ("Zs", "Zl", "Zp"):
                parts.append((chr(cp), [" "], "space"))
                changing.append(cp)
            elif kind == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
                parts.append((chr(cp), [], "invisible"))
                changing.append(cp)
    return parts, composed, "".join(map(chr, sorted(set(changing))))


PARTS, COMPOSED, CHANGING = _mapping_rows()
#: A usual Latin letter, in its ordinary or full-width form.
_LATIN = r"A-Za-z\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{C0}-\x{CF}\x{D1}-\x{D6}\x{D9}-\x{DD}\x{E0}-\x{EF}\x{F1}-\x{F6}\x{F9}-\x{FD}\x{102}\x{103}\x{110}\x{111}\x{128}\x{129}\x{168}\x{169}\x{1A0}\x{1A1}\x{1AF}\x{1B0}\x{1EA0}-\x{1EF9}"
_RUN = r"[\p{L}\p{M}\p{Cf}]"


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    parts = spark.createDataFrame(PARTS, "ch string, parts array<string>, kind string")
    return parts, spark.createDataFrame(COMPOSED, "seg string, whole string")


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^ \n\r\t]+|[ \n\r\t]+"), F.lit(0))


def _changes(text: Column) -> Column:
    """Whether a text holds a character that some mapping changes: one table look-up a character, where a class of many ranges tries each."""
    return F.length(F.translate(text, CHANGING, "")) < F.length(text)


def _suspects(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"[ \n\r\t]+"), lambda t: _changes(t)))


def dictionary(pieces: DataFrame) -> DataFrame:
    """(piece) -> (piece, fixed, kinds): how each distinct piece is written usually and which kinds of forms it held."""
    spark = pieces.sparkSession
    parts, composed = _tables(spark)
    looks = spark.createDataFrame(list(LOOK_ALIKE.items()), "ch string, usual string")
    units = pieces.select("piece", F.posexplode(F.regexp_extract_all("piece", F.lit(f"{_RUN}+|[^\\p{{L}}\\p{{M}}\\p{{Cf}}]+"), F.lit(0))).alias("u", "unit"))
    units = units.withColumn("latin", F.regexp_like("unit", F.lit(f"[{_LATIN}]")))
    points = units.select("piece", "u", "latin", F.posexplode(F.regexp_extract_all("unit", F.lit(r"(?s)."), F.lit(0))).alias("p", "ch"))
    alike = F.col("latin") & F.col("usual").isNotNull()
    # a look-alike stands for one letter, then all decompose
    points = points.join(F.broadcast(looks), "ch", "left").withColumn("letter", F.when(alike, F.col("usual")).otherwise(F.col("ch")))
    points = points.join(F.broadcast(parts.withColumnRenamed("ch", "letter")), "letter", "left")
    mark = F.regexp_like("ch", F.lit(r"\p{Mn}"))
    points = points.withColumn(
        "kind", F.when(alike, "look_alike").when(F.col("kind") == "singleton", "singleton").when(F.col("kind").isNotNull(), F.col("kind")).when(mark, "combining")
    )
    kinds = points.where("kind is not null").groupBy("piece").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    subs = points.select("piece", "u", "p", F.posexplode(F.coalesce("parts", F.array("letter"))).alias("k", "c"))
    classes = [(chr(cp), unicodedata.combining(chr(cp))) for low, high in _MARKS for cp in range(low, high) if unicodedata.combining(chr(cp))]
    subs = subs.join(F.broadcast(spark.createDataFrame(classes, "c string, ccc int")), "c", "left").withColumn("ccc", F.coalesce("ccc", F.lit(0)))
    order = Window.partitionBy("piece").orderBy("u", "p", "k").rowsBetween(Window.unboundedPreceding, 0)
    subs = subs.withColumn("seg", F.sum(F.when(F.col("ccc") == 0, 1).otherwise(0)).over(order))
    ordered = F.array_sort(F.collect_list(F.struct("ccc", "u", "p", "k", "c")))
    segs = subs.groupBy("piece", F.col("seg").alias("n")).agg(ordered.alias("cs"))
    segs = segs.withColumn("seg", F.array_join(F.transform("cs", lambda x: x["c"]), ""))
    segs = segs.join(F.broadcast(composed), "seg", "left").withColumn("out", F.coalesce("whole", _by_pairs(F.col("cs"))))
    built = segs.groupBy("piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "out"))), lambda x: x["out"]), "").alias("fixed"))
    # a piece of invisible characters only leaves nothing
    return pieces.join(built, "piece", "left").join(kinds, "piece", "left").select("piece", F.coalesce("fixed", F.lit("")).alias("fixed"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))


def _by_pairs(chars: Column) -> Column:
    """Canonical composition of a letter and its ordered marks that no single letter stands for: pair by pair.

    A mark that stays apart blocks later ones of its own class.
    """
    pairs = {}
    for whole, ch in COMPOSED:
        two = unicodedata.normalize("NFC", whole[:-1]) + whole[-1]
        if len(two) == 2:
            pairs[two] = ch
    table = F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")  # folded to one constant

    def step(state: Column, x: Column) -> Column:
        joined = F.when(state["last"] != x["ccc"], F.try_element_at(table, F.concat(state["letter"], x["c"])))
        return F.when(joined.isNotNull(), F.struct(joined.alias("letter"), state["rest"].alias("rest"), state["last"].alias("last"))).otherwise(
            F.struct(state["letter"].alias("letter"), F.concat(state["rest"], x["c"]).alias("rest"), x["ccc"].alias("last"))
        )

    start = F.struct(F.get(chars, 0)["c"].alias("letter"), F.lit("").alias("rest"), F.lit(-1).alias("last"))
    folded = F.aggregate(F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))), start, step)
    return F.when(F.size(chars) < 2, F.get(chars, 0)["c"]).otherwise(F.concat(folded["letter"], folded["rest"]))


def changes(texts: DataFrame, key: list[str], text_col: str) -> DataFrame:
    """(key..., map, kinds) of the texts with other forms: what each of their pieces becomes, and the kinds they hold."""
    held = texts.where(_changes(F.col(text_col))).select(*key, F.explode(_suspects(F.col(text_col))).alias("piece")).distinct()
    held = stage(held)
    known = stage(dictionary(held.select("piece").distinct()))
    known = known.where("fixed <> piece or size(kinds) > 0")
    return held.join(known, "piece").groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.struct("piece", "fixed"))).alias("map"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds")
    )


def normalised(texts: DataFrame, key: list[str], text_col: str) -> DataFrame:
    """(key..., text): every text, in its usual form."""
    fixes = changes(texts, key, text_col)
    same = [texts[k].eqNullSafe(fixes[k]) for k in key]
    fixed = F.array_join(F.transform(_pieces(F.col(text_col)), lambda t: F.coalesce(F.try_element_at("map", t), t)), "")
    return texts.join(fixes, same, "left").select(*[texts[k] for k in key], F.when(F.col("map").isNull(), F.col(text_col)).otherwise(fixed).alias("text"))


def corpus(results: DataFrame, comparison: DataFrame) -> DataFrame:
    """(table_name, row_key, body) of the two text columns concerned, without repeated rows."""
    a = results.select(F.lit("ocr_results").alias("table_name"), F.col("id").alias("row_key"), F.col("corrected_text").alias("body"))
    b = comparison.select(F.lit("ocr_comparison").alias("table_name"), F.col("image").alias("row_key"), F.col("ground_truth").alias("body"))
    return a.unionByName(b)


def found(results: DataFrame, comparison: DataFrame) -> DataFrame:
    """(table_name, row_key) of the rows whose text holds another form of what looks the same."""
    rows = corpus(results, comparison).where("row_key is not null and body is not null")
    return changes(rows, ["table_name", "row_key"], "body").where("size(array_except(kinds, array('singleton'))) > 0").select("table_name", "row_key")


def texts(results: DataFrame, comparison: DataFrame) -> DataFrame:
    """(table_name, row_key, text) of every row in its usual form."""
    rows = corpus(results, comparison).distinct()
    return normalised(rows, ["table_name", "row_key"], "body")


def found_sql() -> str:
    """The definition of the cases by Unicode's own properties and scripts, without this module's tables."""
    run, latin = r"[\p{L}\p{M}\p{Cf}]*", r"[A-Za-z\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{C0}-\x{CF}\x{D1}-\x{D6}\x{D9}-\x{DD}\x{E0}-\x{EF}\x{F1}-\x{F6}\x{F9}-\x{FD}\x{102}\x{103}\x{110}\x{111}\x{128}\x{129}\x{168}\x{169}\x{1A0}\x{1A1}\x{1AF}\x{1B0}\x{1EA0}-\x{1EF9}]"
    other = r"[\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}\x{D0}\x{F0}\x{131}\x{180}-\x{19F}\x{1A2}-\x{1AE}\x{1B1}-\x{24F}\p{Nl}\x{250}-\x{2AF}\x{1D00}-\x{1D2B}\x{A731}\x{1D400}-\x{1D7FF}]"
    pattern = r"[\p{Cf}\p{Zl}\p{Zp}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{FE00}-\x{FE0F}\x{FF01}-\x{FF5E}\x{FFE0}-\x{FFE6}\x{300}-\x{36F}]" + f"|{latin}{run}{other}|{other}{run}{latin}"
    return (
        f"SELECT DISTINCT 'ocr_results' AS table_name, id AS row_key FROM ocr_results WHERE regexp_matches(corrected_text, '{pattern}') "
        f"UNION SELECT DISTINCT 'ocr_comparison', image FROM ocr_comparison WHERE regexp_matches(ground_truth, '{pattern}')"
    )
