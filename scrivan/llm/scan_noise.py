"""Noise of scanned pages: words broken over lines, misread characters, running headers and page numbers.

* Word counts over all texts come first. Rare words are joined with frequent ones in SQL by anagram hashes: the hash of a
  word is a sum over its characters, so a confusion (``h`` read as ``li``) shifts it by a constant; a rare word joins the
  frequent words whose hash differs by the shift of one or two confusions, and a candidate stays if the confusions turn
  the one into the other. The most frequent variant wins, if it is ``RATIO`` times as frequent.
* Edge lines: a line whose letters are those of a line that often opens a text is a header, and a running one if the
  text has it twice or more; so is any line that opens two pages of a text, whatever other texts hold; page numbers are lines of a page-number shape, or a number at the end of a running header.
* A line end with a mark is a broken word if the halves together are a known word, or if a half alone is none; page
  furniture between the halves is stepped over.

Nothing depends on the size of the collection: a word is trusted when it stands ``LEAST`` times and is no variant of one
``RATIO`` times as frequent. The tables are broadcast where their checked size allows; beyond it each block of texts is
joined with the words it looks up, with the same result.

Cases: null texts give no row, empty ones an empty text and no noise; repeated rows count once; ties between variants
fall to the smaller word; empty tables give empty results; texts of any length are handled whole; other columns are
ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations_with_replacement

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivan.llm.words import fold_table, words
from scrivan.runtime import stage

# What is printed and what it is misread as.
CONFUSIONS = [
    ("h", "li"), ("n", "ri"), ("i", "l"), ("o", "0"), ("c", "e"), ("m", "rn"), ("l", "1"), ("đ", "d"), ("u", "ii"), ("g", "q"), ("d", "cl"),
    ("s", "5"), ("b", "8"), ("ư", "u"), ("ả", "à"), ("ậ", "ạ"), ("ọ", "o"), ("ă", "â"), ("ế", "é"), ("ấ", "á"), ("ữ", "ũ"), ("ố", "ó"), ("ộ", "ọ"),
    ("ợ", "ọ"), ("ề", "è"),
]
#: Those that only drop or change an accent: no evidence inside a name.
SOFT = {("đ", "d"), ("ư", "u"), ("ả", "à"), ("ậ", "ạ"), ("ọ", "o"), ("ă", "â"), ("ế", "é"), ("ấ", "á"), ("ữ", "ũ"), ("ố", "ó"), ("ộ", "ọ"), ("ợ", "ọ"), ("ề", "è")}
PRIME = 2**61 - 1
#: Times a trusted word stands in the texts at least, and how much more often than its misread form.
LEAST, RATIO = 20, 12
#: Words (corrections and trusted ones) that are broadcast; of more, each block of ``BLOCK`` texts gets its own by a join.
MOST_WORDS, BLOCK = 2_000_000, 2_000

_WORD, _NOT_LETTERS = re.compile(r"[^\W_]+"), re.compile(r"[^a-z]+")
_BREAK = re.compile(r"([^\W\d_]+)(-|¬|­|‐|‑)[ \t]*$")
_NUMBER_LINE = re.compile(r"(?i)^\W*(?:(?:trang|page|tr\.?|p\.)\s*\d{1,4}(?:\s*(?:/|of|trên)\s*\d{1,4})?|\d{1,4}\s*/\s*\d{1,4}|[-–—~\[(]\s*\d{1,4}\s*[-–—~\])]|\d{1,4})\W*$")
_END_NUMBER = re.compile(r"^\W*\d{1,4}(?=\s)|(?<=\s)\d{1,4}(?=\W*$)")
_PLAIN_NUMBER = re.compile(r"^\s*\d{1,4}\s*$")
_DIGITS = re.compile(r"(?<![^\W_])(?=[\dlIOoSBZ]*\d[\dlIOoSBZ]*[lIOoSBZ]|[\dlIOoSBZ]*[lIOoSBZ][\dlIOoSBZ]*\d)[\dlIOoSBZ]{3,}(?![^\W_])")
_MIXED = re.compile(r"\d[lIOoSBZ]|[lIOoSBZ]\d")
_AS_DIGIT = str.maketrans("lIOoSBZ", "1100582")
_HYPHENS = ("-", "¬", "\u00ad", "‐", "‑")
_ENTRY = re.compile(r"(?:[-•*]|\d+[.)])\s")
_HIDDEN = re.compile("[\u200b-\u200d\u2060\ufeff]|\u00ad(?!\\s*\n)")
_BAR = re.compile(r"(?<=[^\W_])\|(?=[^\W_])")


def anagram_hash(word: str) -> int:
    """A sum over the characters that ignores their order, modulo a prime."""
    return sum(ord(c) ** 5 for c in word) % PRIME


def applied(word: str, what: list[tuple[str, str]]) -> set[str]:
    """Every string that the confusions make of a word, each used once, none on what another one made."""
    out = {(word, 0)}
    for right, wrong in what:
        out = {(w[:i] + wrong + w[i + len(right) :], i + len(wrong)) for w, at in out for i in range(at, len(w)) if w.startswith(right, i)}
    return {w for w, _ in out}


def _shifts() -> pd.DataFrame:
    rows = []
    for n in (1, 2):
        for what in combinations_with_replacement(range(len(CONFUSIONS)), n):
            shift = sum(anagram_hash(CONFUSIONS[k][1]) - anagram_hash(CONFUSIONS[k][0]) for k in what) % PRIME
            rows.append((shift, list(what), all(CONFUSIONS[k] in SOFT for k in what)))
    return pd.DataFrame(rows, columns=["shift", "what", "soft"])


def texts_of(results: DataFrame) -> DataFrame:
    """(ocr_id, field_name, body): both text columns, without repeated rows."""
    rows = results.where("id is not null").select("id", "raw_text", "corrected_text").dropDuplicates(["id"])
    both = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("body")) for c in ("raw_text", "corrected_text")])
    return rows.select(F.col("id").alias("ocr_id"), F.inline(both)).where("body is not null")


def usual(body: str) -> str:
    """Composed letters, without invisible characters inside lines: those are another problem's and no misreading."""
    if not unicodedata.is_normalized("NFC", body):
        body = unicodedata.normalize("NFC", body)
    return _HIDDEN.sub("", body) if any(c in body for c in "\u200b\u200c\u200d\u2060\ufeff\u00ad") else body


@lru_cache(50_000)
def line_key(line: str) -> str:
    """The letters of a line without case, accents and digits."""
    low = line.lower()
    if not low.isascii():
        low = low.translate(fold_table())
        if not low.isascii():
            low = "".join(words(line))
    return _NOT_LETTERS.sub("", low)


def counts(texts: DataFrame) -> DataFrame:
    """(kind, token, n): words of all texts (``w``), and lines that open a text or follow a page number (``h``)."""

    def tally(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen, lines = Counter(), Counter()
            for body in frame.body:
                body = usual(body)
                seen.update(_WORD.findall(body.lower()))
                top = True
                for line in body.split("\n"):
                    bare = line.strip()
                    if not bare or not (top or len(bare) < 40):
                        top = top and not bare
                        continue
                    if top and line.rstrip()[-1] not in ".;,!?" and len(key := line_key(line)) >= 8:
                        lines[key] += 1
                    top = bool(_NUMBER_LINE.match(line))
            rows = [("w", k, n) for k, n in seen.items()] + [("h", k, n) for k, n in lines.items()]
            yield pd.DataFrame(rows, columns=["kind", "token", "n"])

    return texts.select("body").mapInPandas(tally, "kind string, token string, n bigint").groupBy("kind", "token").agg(F.sum("n").alias("n"))


@F.pandas_udf(T.LongType())
def _hash(tokens: pd.Series) -> pd.Series:
    return tokens.map(anagram_hash)


@F.pandas_udf(T.BooleanType())
def _explained(frequent: pd.Series, rare: pd.Series, what: pd.Series) -> pd.Series:
    return pd.Series([b in applied(a, [CONFUSIONS[k] for k in w]) or b in applied(a, [CONFUSIONS[k] for k in reversed(w)]) for a, b, w in zip(frequent, rare, what)])


def corrections(counted: DataFrame) -> DataFrame:
    """(rare, word, soft, ratio): rare words that are a frequent one misread, with the most frequent such word."""
    spark = counted.sparkSession
    tokens = counted.where("kind = 'w'").select("token", "n", _hash("token").alias("h"))
    frequent = tokens.where(F.col("n") >= LEAST).where(~F.regexp_like("token", F.lit(r"\d"))).where(F.length("token") > 1).toDF("word", "m", "hw")
    shifts = spark.createDataFrame(_shifts())
    each = F.explode(F.lit([int(x) for x in sorted(set(_shifts()["shift"]))]).cast("array<bigint>"))  # a fixed few shifts a word
    moved = tokens.where(F.length("token") > 1).withColumn("shift", each).withColumn("hw", F.pmod(F.col("h") - F.col("shift"), F.lit(PRIME)))
    met = moved.join(frequent, "hw").join(F.broadcast(shifts), "shift").where((F.col("m") >= F.col("n") * RATIO) & (F.col("word") != F.col("token")))
    letters = F.length(F.regexp_replace("token", r"\d", ""))
    met = met.where((letters * 2 > F.length("token")) & _explained("word", "token", "what"))
    best = F.max(F.struct(F.col("m"), (~F.col("soft")).alias("hard"), F.col("word"))).alias("b")
    return met.groupBy("token", "n").agg(best).select(F.col("token").alias("rare"), F.col("b.word").alias("word"), (~F.col("b.hard")).alias("soft"), (F.col("b.m") / F.col("n")).alias("ratio"))


class Repair:
    """The repairs of one text; made once a task from what the whole collection tells."""

    def __init__(self, fixes: dict[str, tuple[str, bool, float]], known: set[str], headers: list[str]) -> None:
        self.fixes, self.known = fixes, known
        self.headers = {h: k for k, h in enumerate(headers)}
        self.longest = int(1.6 * max(map(len, headers), default=0)) + 12  # of a header line with its blanks and number
        self.grams: dict[int, list[tuple[int, set[str]]]] = {}
        for h, k in self.headers.items():
            self.grams.setdefault(len(h), []).append((k, {h[i : i + 2] for i in range(len(h) - 1)}))
        self.seen: dict[str, int] = {}

    def header_of(self, key: str) -> int:
        """Which header a line is, perhaps misread a little; -1 for none."""
        if key in self.headers:
            return self.headers[key]
        if not 8 <= len(key) <= 60:
            return -1
        if (known := self.seen.get(key)) is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            known = self.seen[key] = self.nearest(key)
        return known

    def nearest(self, key: str) -> int:
        mine = {key[i : i + 2] for i in range(len(key) - 1)}
        best = (0.0, -1)
        for size in range(len(key) - 6, len(key) + 7):
            for k, g in self.grams.get(size, ()):
                both = len(mine & g)
                best = max(best, (both / (len(mine) + len(g) - both), k))
        return best[1] if best[0] >= 0.6 else -1

    @staticmethod
    def own_headers(lines: list[str], tops: list[int]) -> set[int]:
        """Lines of a header that only this text has: one that opens a page twice or more, perhaps misread a little, or that stands with a number of its own each time."""
        out: set[int] = set()
        first = lines[tops[0]].strip() if tops else ""
        numbered = len(first) >= 8 and _END_NUMBER.search(first) is not None
        if len(tops) < 2 and not numbered:
            return out
        keys = {i: line_key(lines[i]) for i in tops if len(lines[i]) >= 8 and lines[i].rstrip()[-1] not in ".;,!?"}
        keys = {i: k for i, k in keys.items() if len(k) >= 8}
        same = lambda i: {j for j, x in enumerate(lines) if abs(len(x.strip()) - len(lines[i].strip())) <= 8 and line_key(x) == keys[i]}
        if numbered and tops[0] in keys and len(all_ := same(tops[0])) > 1:
            numbers = [m.group() for j in all_ if (m := _END_NUMBER.search(lines[j].strip()))]
            if len(numbers) == len(all_) == len(set(numbers)):
                out |= all_
        grams = {i: {k[j : j + 2] for j in range(len(k) - 1)} for i, k in keys.items()}
        for i in keys:
            if i not in out:
                alike = [j for j in keys if j != i and (keys[i] == keys[j] or len(grams[i] & grams[j]) >= 0.6 * len(grams[i] | grams[j]))]
                if alike:
                    out |= {i, *alike} | same(i)
        return out

    def furniture(self, lines: list[str]) -> tuple[set[int], set[int], set[int]]:
        """Lines that are running headers, page numbers, and running headers with a page number."""
        pages = {i for i, x in enumerate(lines) if x and (len(x) < 40 or x[0] == " " and len(x.strip()) < 40) and _NUMBER_LINE.match(x)}
        tops = [next((i for i in range(at, len(lines)) if lines[i].strip() and i not in pages), -1) for at in sorted({0, *(i + 1 for i in pages)})]
        tops = sorted({i for i in tops if i >= 0})
        keys = [line_key(x) if 8 <= len(x) <= self.longest and x.rstrip()[-1:] not in ".;,!?" else "" for x in lines]
        of = {i: h for i, k in enumerate(keys) if k and (h := self.header_of(k)) >= 0}
        often = Counter(of.values())
        running = {i for i, h in of.items() if often[h] > 1}
        running |= self.own_headers(lines, [i for i in tops if i not in running])
        numbered = set()
        ends = {i: m for i in running if (m := re.search(r"(?:^\W*(\d{1,4})\s)|(?:\s(\d{1,4})\W*$)", lines[i]))}
        if len({m.group(0).strip() for m in ends.values()}) > 1 or (ends and len(ends) == len(running)):
            numbered = set(ends)
        plain = [i for i in pages if _PLAIN_NUMBER.match(lines[i])]
        if plain:
            values = [int(lines[i]) for i in plain]
            steps = [j for j in range(len(plain)) if (j and values[j] == values[j - 1] + 1) or (j + 1 < len(plain) and values[j + 1] == values[j] + 1)]
            kept = {plain[j] for j in steps}
            filled = [i for i, x in enumerate(lines) if x.strip()]
            for i in plain:  # a lone number is one only at the foot, or right above a running header
                after = next((j for j in filled if j > i), None)
                if i not in kept and ((i == filled[-1] and len(filled) > 3) or after in running):
                    kept.add(i)
            pages -= set(plain) - kept
        return running, pages, numbered

    def word(self, token: str, in_name: bool) -> str | None:
        """What a misread word was; null if it is none."""
        fix = self.fixes.get(token.lower())
        if fix is None or (in_name and fix[1]) or (len(token) < 3 and fix[1]):
            return None
        good = fix[0]
        return good.upper() if token.upper() == token and len(token) > 2 and any(c.isalpha() for c in token) and not any(c.islower() for c in token) else good[0].upper() + good[1:] if token[0].isupper() else good

    def run(self, body: str) -> tuple[str, set[str]]:
        """The text in continuous paragraphs, and the kinds of noise it had."""
        kinds: set[str] = set()
        lines = usual(body).split("\n")
        running, pages, numbered = self.furniture(lines)
        if running:
            kinds.add("running_header")
        if pages or numbered:
            kinds.add("page_number")
        kept = [x for i, x in enumerate(lines) if i not in running and i not in pages]
        known = self.known
        out: list[str] = []
        for line in kept:
            m = _BREAK.search(out[-1]) if out and out[-1].rstrip(" \t")[-1:] in _HYPHENS else None
            if m and line.strip():
                tail = re.match(r"\s*([^\W\d_]+)", line)
                if tail:
                    head, rest = m.group(1), tail.group(1)
                    joined = (head + rest).lower()
                    lower = rest[0].islower() or (head.isupper() and rest.isupper())
                    whole = joined in known or (self.fixes.get(joined) is not None)
                    if lower and (whole or rest[0].islower() and (m.group(2) != "-" or head.lower() not in known or rest.lower() not in known)) and not _address_like(out[-1], line):
                        kinds.add("hyphen_break")
                        out[-1] = out[-1][: m.start(2)] + line.lstrip()
                        continue
            out.append(line)
        text = "\n".join(out)
        fixed = _BAR.sub(" ", text) if "|" in text else text
        if fixed != text:
            kinds.add("char_error")
        odd = not self.fixes.keys().isdisjoint(_WORD.findall(fixed.lower())) or _MIXED.search(fixed) is not None
        spans = list(_WORD.finditer(fixed)) if odd else []
        built, at = [], 0
        for k, m in enumerate(spans):
            token = m.group()
            good = None
            if token.lower() in self.fixes and not _in_address(fixed, m.start(), m.end()):
                upper = token[0].isupper()
                beside = upper and ((k and spans[k - 1].group()[0].isupper() and fixed[spans[k - 1].end() : m.start()] == " ") or (k + 1 < len(spans) and spans[k + 1].group()[0].isupper() and fixed[m.end() : spans[k + 1].start()] == " "))
                good = self.word(token, beside)
            elif _DIGITS.fullmatch(token) and not _in_address(fixed, m.start(), m.end()) and sum(c.isdigit() for c in token) * 2 >= len(token):
                good = token.translate(_AS_DIGIT)
            if good is not None:
                kinds.add("char_error")
                built.append(fixed[at : m.start()] + good)
                at = m.end()
        built.append(fixed[at:])
        return paragraphs("".join(built)), kinds


def _in_address(text: str, start: int, end: int) -> bool:
    """Whether a word belongs to an e-mail address."""
    left = text[max(0, start - 40) : start].split()[-1:] if start and not text[start - 1].isspace() else []
    right = text[end : end + 40].split()[:1] if end < len(text) and not text[end].isspace() else []
    return "@" in "".join(left + right)


def _address_like(before: str, after: str) -> bool:
    return "@" in (after.split() or [""])[0] or "@" in (before.split() or [""])[-1]


def paragraphs(text: str) -> str:
    """Lines joined to paragraphs: a line goes on unless the one before ends a sentence or is blank, or this one begins an entry."""
    out: list[str] = []
    fresh = True
    for line in text.split("\n"):
        bare = line.strip()
        if not bare:
            fresh = True
            continue
        if fresh or not out or (out[-1][-1] in ".!?;:" and bare[0].isupper()) or _ENTRY.match(bare):
            out.append(bare)
        else:
            out[-1] += " " + bare
        fresh = False
    return "\n".join(" ".join(x.split()) for x in out)


def _needed(body: str) -> set[str]:
    """The words that the repair of a text looks up: its own, and what line ends may join."""
    body = usual(body).lower()
    out = set(_WORD.findall(body))
    lines = body.split("\n")
    for i, line in enumerate(lines):
        if line.rstrip(" \t")[-1:] in _HYPHENS and (m := _BREAK.search(line)):
            out |= {m.group(1) + t.group(1) for x in lines[i + 1 : i + 9] if (t := re.match(r"\s*([^\W\d_]+)", x))}
    return out


def _in_blocks(texts: DataFrame, fixes: DataFrame, known: DataFrame, headers: list[str], schema: str) -> DataFrame:
    """The repair where the words are too many to broadcast: each block of texts meets the words it looks up. Same result."""
    blocks = max(1, -(-texts.count() // BLOCK))
    placed = texts.withColumn("block", F.pmod(F.xxhash64("ocr_id", "field_name"), F.lit(blocks)))

    def words_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen = {(block, w) for block, body in zip(frame.block, frame.body) for w in _needed(body)}
            yield pd.DataFrame(list(seen), columns=["block", "token"])

    asked = placed.select("block", "body").mapInPandas(words_of, "block bigint, token string").distinct()
    told = asked.join(fixes.withColumnRenamed("rare", "token"), "token", "left").join(known.withColumn("known", F.lit(True)), "token", "left").where("word is not null or known")

    def run(key: tuple, frame: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        wrong = mine[mine.word.notna()]
        table = {t: (w, bool(x), r) for t, w, x, r in zip(wrong.token, wrong.word, wrong.soft, wrong.ratio)}
        repair = Repair(table, set(mine.token[mine.known.notna()]) - set(table), headers)
        done = [repair.run(body) for body in frame.body]
        return pd.DataFrame({"ocr_id": frame.ocr_id, "field_name": frame.field_name, "text": [t for t, _ in done], "kinds": [sorted(k) for _, k in done]})

    return placed.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(run, schema)


def repaired(results: DataFrame) -> DataFrame:
    """(ocr_id, field_name, text, kinds) of every text."""
    spark = results.sparkSession
    texts = texts_of(results)
    counted = stage(counts(texts))
    fixes = stage(corrections(counted))
    known = counted.where((F.col("kind") == "w") & (F.col("n") >= LEAST)).select("token")
    n_tops = counted.where("kind = 'h'").agg(F.sum("n")).first()[0] or 0
    # headers that texts share, which tell a misread one in a text of few pages; at most 500 lines have such a share
    tops = counted.where("kind = 'h'").where(F.col("n") >= max(5, n_tops * 0.002)).orderBy(F.desc("n"), "token")
    headers: list[str] = [r.token for r in tops.select("token").collect()]
    schema = "ocr_id string, field_name string, text string, kinds array<string>"
    if fixes.count() + known.count() > MOST_WORDS:
        return _in_blocks(texts, fixes, known, headers, schema)
    table = {r.rare: (r.word, r.soft, r.ratio) for r in fixes.toLocalIterator()}
    trusted = {r.token for r in known.toLocalIterator()} - set(table)
    tool = spark.sparkContext.broadcast(Repair(table, trusted, headers))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repair = tool.value
        for frame in frames:
            done = [repair.run(body) for body in frame.body]
            yield pd.DataFrame({"ocr_id": frame.ocr_id, "field_name": frame.field_name, "text": [t for t, _ in done], "kinds": [sorted(k) for _, k in done]})

    return texts.mapInPandas(run, schema)


def found(results: DataFrame) -> DataFrame:
    """(ocr_id, field_name, noise_kind)"""
    return repaired(results).select("ocr_id", "field_name", F.explode("kinds").alias("noise_kind"))


def clean(results: DataFrame) -> DataFrame:
    """(ocr_id, field_name, text)"""
    return repaired(results).select("ocr_id", "field_name", "text")
