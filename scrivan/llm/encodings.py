"""Garbled text from wrong character encodings.

Each source's swaps are treated as substitution ciphers. The characters seen are emitted by hidden letters that follow
the letter bigrams of the collection's frequent words (composed, and with tones apart as some pages write them):
expectation-maximization with forward and backward sums over the runs of non-ASCII characters of unknown words learns
what each character stands for, first for all sources together, then per source with that as the prior. A word's
likeliest frequent reading under its source's cipher counts if it is far more frequent than the word; the deciphered
words of a text make one translation table, and the text's other odd words go through ``translate()`` with it.

A run that stands for one letter by several characters is no substitution of characters: words whose bytes fit UTF-8's
form are read back exactly through the public code pages, up to three times. Single-byte pages are consulted only
beside the cipher, for symbols too rare to learn. A replacement character is a case by itself; accents written apart
are none.

Counts are aggregated before they are grouped by source, so a hot source is as small as the alphabet. Frequent words
are at most 1 / ``SHARE`` in number and are broadcast.

Cases: null and empty texts are no cases; a null source is a source of its own; repeated rows count once; ties fall to
the smaller letter; empty tables give empty results; texts of any length are handled whole; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivan.runtime import stage

SHARE, LEAST, RATIO = 2e-6, 10, 10
#: Rounds of learning, those by bigrams alone among them, symbols in a run, the least probability of a letter, counts that the pooled cipher lends.
ROUNDS, PLAIN, LONGEST_RUN, LIKELY, WEIGHT = 30, 20, 4, 0.02, 20.0

_BASES = "aăâeêioôơuưy"
_TONES = ["", "̀", "́", "̃", "̉", "̣"]
_LOWER = sorted({unicodedata.normalize("NFC", b + t) for b in _BASES for t in _TONES} | set("abcdefghijklmnopqrstuvwxyzđ") | set("àâæçéèêëîïôœùûüÿ"))
LETTERS = _LOWER + sorted({c.upper() for c in _LOWER if len(c.upper()) == 1} - set(_LOWER))
USUAL = set(LETTERS) | {chr(c) for c in range(32, 127)} | set("“”‘’–—…«»€£°•\t\n\r\xa0 ·×²³½‑")
_TONES_SET = set(_TONES) - {""}
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_RUN, _CUT = re.compile(r"[^\x00-\x7f]+"), re.compile(r"[-/]")

# The single-byte Vietnamese code of the national standard TCVN 5712 (third set), from byte 0xA1 on.
_TCVN3 = "ĂÂÊÔƠƯĐăâêôơưđ"
_TCVN3_AT = {0xB5: "àảãáạ", 0xBB: "ằẳẵắ", 0xC6: "ặầẩẫấậè", 0xCE: "ẻẽéẹềểễếệìỉ", 0xDC: "ĩíịò", 0xE1: "ỏõóọồổỗốộờởỡớợù", 0xF1: "ủũúụừửữứựỳỷỹýỵ"}
_tcvn3 = {0xA1 + k: c for k, c in enumerate(_TCVN3)} | {at + k: c for at, run in _TCVN3_AT.items() for k, c in enumerate(run)}
SHOWN = ("cp1252", "latin-1", "cp1258", "cp437", "mac_roman", "cp850", "cp1250", "cp1254", "iso8859-15", "cp1251", "koi8_r", "cp1257", "cp852")
WRITTEN = ("tcvn3", "cp1258", "cp1252", "mac_roman", "cp437", "cp850")


def _to_bytes(page: str) -> dict[int, int]:
    """Character -> byte of a code page; bytes that a page leaves open show as the control characters of their number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[ord(bytes([b]).decode(page))] = b
        except UnicodeDecodeError:
            out[b] = b
    return out


_PAGES = {page: _to_bytes(page) for page in SHOWN}
_READ = {"tcvn3": {b: _tcvn3.get(b, chr(b)) for b in range(0x80, 0x100)}}
for _page in WRITTEN[1:]:
    _READ[_page] = {b: chr(c) for c, b in _PAGES.get(_page, _to_bytes(_page)).items()}


#: Character -> the Latin-1 character of its byte; what a page doesn't have becomes a character that Latin-1 doesn't have.
_SHIFTS = {page: dict.fromkeys(range(0x80, 0x100), 0x100) | table for page, table in _PAGES.items()}
#: What any page can read as UTF-8: every run of other characters is made of first bytes with one to three bytes that go on.
_FIRST, _ON = ("".join(re.escape(chr(c)) for c in sorted({c for t in _PAGES.values() for c, b in t.items() if low <= b <= high})) for low, high in ((0xC2, 0xF4), (0x80, 0xBF)))
_MAYBE_UTF8 = re.compile(rf"[\x00-\x7f]*(?:(?:[{_FIRST}][{_ON}]{{1,3}})+[\x00-\x7f]*)*")


def _back(word: str, page: str) -> bytes | None:
    try:
        return word.translate(_SHIFTS[page]).encode("latin-1")
    except UnicodeEncodeError:
        return None


def _usual(word: str) -> bool:
    return USUAL.issuperset(word)


def utf8_readings(word: str, deep: int = 3) -> Iterator[str]:
    """The word read back as UTF-8 from every page that could have shown it."""
    if not _MAYBE_UTF8.fullmatch(word):
        return
    for page in SHOWN:
        raw = _back(word, page)
        if raw is None:
            continue
        try:
            read = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if read != word:
            if deep > 1 and not read.isascii():
                yield from utf8_readings(read, deep - 1)
            yield read


def page_readings(word: str) -> Iterator[tuple[tuple[str, str], str]]:
    """The word read back from one single-byte page as another, with the two pages."""
    for shown in ("cp1252", "latin-1", "cp437", "mac_roman", "cp850"):
        raw = _back(word, shown)
        if raw is None:
            continue
        for written in WRITTEN:
            if written != shown:
                table = _READ[written]
                yield (shown, written), unicodedata.normalize("NFC", "".join(chr(b) if b < 0x80 else table[b] for b in raw))


def words_of(text: str) -> list[str]:
    """What stands between ASCII blanks; other blanks may be halves of a garbled letter."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def core(word: str) -> str:
    """A word without the ASCII marks around it, in lower case."""
    return word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”‘’«»…–—").lower()


def counts(documents: DataFrame) -> DataFrame:
    """(source, token, low, n): the words of all texts without the ASCII marks around them, and their ``core``; those of ASCII letters without a source."""

    def tally(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            by_source: dict[str, Counter] = {}
            for source, text in zip(frame.source, frame.text):
                by_source.setdefault(source, Counter()).update(words_of(text))
            bare: Counter = Counter()
            for source, words in by_source.items():
                for word, n in words.items():
                    if word.isascii():
                        bare["", core(word)] += n
                    else:
                        bare[source, word.strip(_MARKS)] += n
            rows = [(source, word, core(word), n) for (source, word), n in bare.items() if word]
            yield pd.DataFrame(rows, columns=["source", "token", "low", "n"])

    rows = documents.select(F.coalesce("source", F.lit("")).alias("source"), "text")
    return rows.mapInPandas(tally, "source string, token string, low string, n bigint").groupBy("source", "token", "low").agg(F.sum("n").alias("n"))


def pieces(word: str) -> list[str]:
    """The parts of a number or a compound."""
    return [x.strip(_MARKS) for x in _CUT.split(word)] if "-" in word or "/" in word else [word]


_runs: dict[str, bool] = {}


def multibyte(word: str) -> bool:
    """Whether every run of non-ASCII characters reads back as UTF-8: such words are no substitution and are read exactly."""
    runs = _RUN.findall(word)
    for run in runs:
        if run not in _runs:
            if len(_runs) > 100_000:
                _runs.clear()
            _runs[run] = len(run) > 1 and any(True for _ in utf8_readings(run))
    return bool(runs) and all(_runs[r] for r in runs)


def surroundings(piece: str) -> Iterator[tuple[str, str, str]]:
    """(before, run, after) of every run of non-ASCII characters: two places to each side with the word's ends."""
    for m in _RUN.finditer(piece):
        yield _RUN.sub("*", "^" + piece[: m.start()])[-2:].lower(), m.group(), _RUN.sub("*", piece[m.end() :] + "$")[:2].lower()


def contexts(counted: DataFrame, known) -> DataFrame:
    """(source, before, run, after, n) of the words that are not known; ``known`` is a broadcast word -> count."""

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clean = known.value
        for frame in frames:
            seen: Counter = Counter()
            for source, word, low, n in zip(frame.source, frame.token, frame.low, frame.n):
                if word.isascii() or low in clean or "\ufffd" in word:
                    continue
                for piece in pieces(word):
                    if piece.isascii() or piece.lower() in clean or multibyte(piece) or any(unicodedata.combining(c) for c in piece):
                        continue
                    for before, run, after in surroundings(piece):
                        if len(run) <= LONGEST_RUN:
                            seen[(source, before, run, after)] += n
            rows = [(*k, n) for k, n in seen.items()]
            yield pd.DataFrame(rows, columns=["source", "before", "run", "after", "n"])

    out = counted.mapInPandas(gather, "source string, before string, run string, after string, n bigint")
    return out.groupBy("source", "before", "run", "after").agg(F.sum("n").alias("n"))


def apart(word: str) -> str:
    """The word with its tones behind their letters, as pages write it that have tones as characters of their own."""
    out = []
    for ch in word:
        marks = unicodedata.normalize("NFD", ch)
        out.append(unicodedata.normalize("NFC", "".join(c for c in marks if c not in _TONES_SET)) + "".join(c for c in marks if c in _TONES_SET))
    return "".join(out)


class Language:
    """Letter bigrams of the frequent words, composed and with tones apart, and which letters stand in which surroundings."""

    def __init__(self, words: pd.DataFrame) -> None:
        self.letters = sorted((set(_LOWER) | _TONES_SET) - set("abcdefghijklmnopqrstuvwxyz"))
        self.index = {c: k for k, c in enumerate(["^", "$", *sorted(set(_LOWER) | _TONES_SET)])}
        table = np.full((len(self.index), len(self.index)), 0.02)
        self.seen: dict[tuple[str, str, int], dict[str, float]] = {}
        for word, n in zip(words.token, words.n):
            for form in {word, apart(word)}:
                for piece in pieces(form):
                    if not piece or not all(c in self.index for c in piece):
                        continue
                    at = self.index["^"]
                    for c in piece:
                        table[at, self.index[c]] += n**0.5
                        at = self.index[c]
                    table[at, self.index["$"]] += n**0.5
                    for before, run, after in surroundings(piece):
                        here = self.seen.setdefault((before, after, len(run)), {})
                        here[run] = here.get(run, 0.0) + n
        self.table = table / table.sum(axis=1, keepdims=True)

    def code(self, c: str, end: str) -> int:
        return self.index.get(c, self.index[end])


def expectation_maximization(frame: pd.DataFrame, language: Language, prior: dict[tuple[str, str], float] | None = None) -> pd.DataFrame:
    """(before, run, after, n) -> (symbol, letter, p, n): what each character of the runs stands for, with probabilities.

    The hidden letters follow the bigrams, the characters seen are emitted by them; forward and backward sums give the
    expected counts. ``PLAIN`` rounds see the bigrams alone; in the rounds after them a reading of the whole run that
    frequent words hold in the same surroundings weighs more. ``prior`` gives expected counts to begin with.
    """
    letters, table = language.letters, language.table
    cols = np.array([language.index[c] for c in letters])
    place = {c: k for k, c in enumerate(letters)}
    symbols = sorted({c for run in frame.run for c in run})
    number = {c: k for k, c in enumerate(symbols)}
    start = np.full((len(letters), len(symbols)), 0.02 / max(1, len(symbols)))
    for (symbol, letter), weight in (prior or {}).items():
        if symbol in number:
            start[place[letter], number[symbol]] += weight
    emit = (start + (0 if prior else 1)) / (start + (0 if prior else 1)).sum(axis=1, keepdims=True)
    groups = []
    for size, part in frame.groupby(frame.run.str.len()):
        runs = np.array([[number[c] for c in run] for run in part.run])
        b = np.array([language.code(x[-1:], "^") for x in part.before])
        a = np.array([language.code(x[:1], "$") for x in part.after])
        groups.append((size, table[b][:, cols], runs, table[cols][:, a].T, part.n.to_numpy(float)))
    inner = table[np.ix_(cols, cols)]
    whole = []
    for before, run, after, n in zip(frame.before, frame.run, frame.after, frame.n):
        if known := language.seen.get((before, after, len(run))):
            total = sum(known.values())
            whole.append(([number[c] for c in run], [([place[c] for c in r], m / total) for r, m in known.items() if all(c in place for c in r)], float(n)))
    counted = start
    for turn in range(ROUNDS):
        new = start.copy()
        if turn < PLAIN or not whole:
            for size, first, runs, last, n in groups:
                alpha = [first * emit[:, runs[:, 0]].T]
                for j in range(1, size):
                    alpha.append((alpha[-1] @ inner) * emit[:, runs[:, j]].T)
                beta = last
                share = n / np.maximum((alpha[-1] * beta).sum(axis=1), 1e-300)
                for j in range(size - 1, -1, -1):
                    np.add.at(new.T, runs[:, j], alpha[j] * beta * share[:, None])
                    if j:
                        beta = (beta * emit[:, runs[:, j]].T) @ inner.T
        else:
            for run, readings, n in whole:
                fit = [m * np.prod([emit[k, s] for k, s in zip(r, run)]) for r, m in readings]
                total = sum(fit)
                if total > 0:
                    for (r, _), f in zip(readings, fit):
                        for k, s in zip(r, run):
                            new[k, s] += n * f / total
        counted = new
        emit = new / new.sum(axis=1, keepdims=True)
    total = counted.sum(axis=0)
    p = counted / total
    at = [(s, k) for s in range(len(symbols)) for k in np.flatnonzero(p[:, s] >= LIKELY)]
    rows = [(symbols[s], letters[k], float(p[k, s]), float(counted[k, s])) for s, k in at]
    return pd.DataFrame(rows, columns=["symbol", "letter", "p", "n"])


def mappings(context: DataFrame, words: pd.DataFrame) -> DataFrame:
    """(source, symbol, letter, p, n) of every source, and of all together (a null source); the cipher of all is the prior of each.

    The pooled contexts (two letters to each side of a run of at most ``LONGEST_RUN`` symbols) are counted over all
    texts; alphabets and syllables bound their number, not the rows.
    """
    spark = context.sparkSession
    context = stage(context)
    language = Language(words)
    pooled = context.groupBy("before", "run", "after").agg(F.sum("n").alias("n")).toPandas()
    schema = "source string, symbol string, letter string, p double, n double"
    if not len(pooled):
        return spark.createDataFrame([], schema)
    first = expectation_maximization(pooled, language)
    total = first.groupby("symbol").n.transform("sum")
    prior = {(s, c): WEIGHT * min(1.0, n / t) for s, c, n, t in zip(first.symbol, first.letter, first.n, total)}
    shared = spark.sparkContext.broadcast((language, prior))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = expectation_maximization(frame, *shared.value)
        out.insert(0, "source", frame.source.iat[0])
        return out

    first.insert(0, "source", None)
    return context.groupBy("source").applyInPandas(run, schema).unionByName(spark.createDataFrame(first, schema))


class Reader:
    """Tells and mends garbled words."""

    def __init__(self, known: dict[str, int], cipher: dict[str | None, dict[str, list[tuple[str, float]]]], pages: bool = True) -> None:
        """``cipher``: source -> symbol -> likely letters (null: all sources); ``pages``: whether single-byte pages are tried where the cipher gives no word."""
        self.known, self.cipher, self.pages = known, cipher, pages
        self.most = max(known.values(), default=0)
        self.memo: dict[str, dict[str, tuple[dict, int]]] = {}
        self.fine: dict[str, set[str]] = {}  # by source, words that are no case
        # what the collection writes only because it is garbled is no evidence
        for w in [w for w in known if not w.isascii() and self.word(w, "")[1]]:
            del known[w]
        self.memo.clear()

    def word(self, word: str, source: str) -> tuple[dict, int]:
        """What the word may have been, by pair of pages, and 2 if it is surely garbled, 1 if it takes a second such word in the text."""
        memo = self.memo.setdefault(source, {})
        if word not in memo:
            if len(memo) > 200_000:
                memo.clear()
            memo[word] = self._word(word, source)
        return memo[word]

    def _word(self, word: str, source: str) -> tuple[dict, int]:
        if "\ufffd" in word:
            return {"utf-8": (self._holes(word), 1)}, 2
        if any(unicodedata.combining(c) for c in word):
            word = unicodedata.normalize("NFC", word)
            if _usual(word):
                return {}, 0
        bare = core(word)
        n = self.known.get(bare, 0)
        plain = _usual(word)
        best = None
        for read in utf8_readings(word):
            if _usual(read) and any(not c.isascii() for c in read):
                rank = (self.known.get(core(read), 0) > 0, -len(read))
                if best is None or rank > best[0]:
                    best = (rank, read)
        if best is not None and (best[0][0] or n == 0 or not plain) and (best[0][0] or len(best[1]) < len(word)):
            return {"utf-8": (best[1], 1)}, 2
        enough = max(LEAST, RATIO * n)
        # no word is so much more frequent that this one could be a garbled form of it
        if plain and enough > self.most and (bare == word or word[1:].islower() or word.isupper()):
            return {}, 0
        cut = re.split(r"([-/])", word)
        if len(cut) > 1:  # parts of a number or a compound
            parts = [({}, 0) if x.isascii() else self.word(x, source) for x in cut]
            level = max((x for _, x in parts), default=0)
            pairs = {p for options, _ in parts for p in options}
            return {p: ("".join(o[p][0] if p in o else x for (o, _), x in zip(parts, cut)), max(o[p][1] for o, _ in parts if p in o)) for p in pairs}, level
        options = {}
        if (coded := self._deciphered(word, source)) is not None:
            options["cipher"] = (coded, self.known.get(core(coded), 0))
        if self.pages:
            for pair, read in page_readings(word):
                if core(read) != bare and _usual(read):
                    options[pair] = (read, self.known.get(core(read), 0))
        options = {p: (read, m) for p, (read, m) in options.items() if m >= enough and (read.isupper() or not word.isupper())}
        if not options:
            return {}, 0
        return options, 1 if plain and not _mixed(word) else 2

    def _deciphered(self, word: str, source: str) -> str | None:
        """The likeliest frequent word among those that the source's cipher makes of a word."""
        table = self.cipher.get(source) or self.cipher.get(None)
        if not table or not all(c in table for c in word if not c.isascii()):
            return None
        choices = [table[c] if not c.isascii() else [(c, 1.0)] for c in word]
        many = sum(len(c) > 1 for c in choices)
        if many > 4:  # long runs: the two likeliest of each
            choices = [c[:2] for c in choices]
        best, most = None, 0.0
        for letters in itertools.product(*choices):
            read = unicodedata.normalize("NFC", "".join(c for c, _ in letters))
            if n := self.known.get(core(read), 0):
                score = n * math.prod(p for _, p in letters)
                if score > most and core(read) != core(word):
                    best, most = read, score
        return None if best is None else _cased(best, word)

    def _holes(self, word: str) -> str:
        """A word with lost bytes: read back where one byte in place of the hole gives a frequent word."""
        if word.count("�") == 1:
            options = {}
            for page in ("cp1252", "latin-1", "cp1258"):
                for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D, 0xA0):
                    for read in utf8_readings(word.replace("�", chr(b)), 2):
                        if _usual(read):
                            options[read] = self.known.get(core(read), 0)
            if options and (read := max(sorted(options), key=options.__getitem__)) and options[read]:
                return read
        return word

    def text(self, text: str, source: str) -> tuple[str, bool]:
        """The text mended, and whether it was garbled. Of several pairs of pages that explain a word, the one that explains most of the text wins."""
        if text.isascii():
            return text, False
        odd = {}
        fine = self.fine.setdefault(source, set())
        if len(fine) > 200_000:
            fine.clear()
        for w in set(words_of(text)).difference(fine):
            if w.isascii():
                if w.isalpha():
                    fine.add(w)
                continue
            got = self.word(w, source)
            if got[1]:
                odd[w] = got
            else:
                fine.add(w)
        if not any(level == 2 for _, level in odd.values()) and len(odd) < 2:
            return text, False
        votes = Counter(p for options, _ in odd.values() for p in options)
        first = {"utf-8": 3, "cipher": 2, ("cp1252", "tcvn3"): 1, ("latin-1", "tcvn3"): 1}
        chosen = {w: max(o.items(), key=lambda x: (votes[x[0]], first.get(x[0], 0), x[1][1], str(x[0]))) for w, (o, _) in odd.items() if o}
        changed = {w: read for w, (_, (read, _)) in chosen.items()}
        changed |= self._translated(text, {w: read for w, (pair, (read, _)) in chosen.items() if pair == "cipher"}, changed)
        return re.sub(r"[^ \t\r\n]+", lambda m: changed.get(m.group(), m.group()), text), True

    def _translated(self, text: str, coded: dict[str, str], done: dict[str, str]) -> dict[str, str]:
        """Unread words of a text whose symbols the text's own deciphered words explain, by one translation table."""
        seen: dict[str, Counter] = {}
        for word, read in coded.items():
            spread = read if len(read) == len(word) else apart(read)
            if len(spread) == len(word):
                for a, b in zip(word, spread):
                    if not a.isascii():
                        seen.setdefault(a, Counter())[b.lower()] += 1
        if len(coded) < 2:
            return {}
        table = {ord(a): max(sorted(c), key=c.__getitem__) for a, c in seen.items()}
        out = {}
        for word in set(words_of(text)):
            odd = [c for c in word if not c.isascii()]
            if odd and word not in done and not _usual(word) and all(ord(c) in table for c in odd):
                out[word] = _cased(unicodedata.normalize("NFC", word.translate(table)), word)
        return out


def _cased(read: str, word: str) -> str:
    """Capitals all through if the word's plain letters are capitals."""
    plain = [c for c in word if c.isascii() and c.isalpha()]
    if plain and all(c.isupper() for c in plain) and (len(plain) > 1 or len(read) == 1):
        return read.upper()
    first = next((k for k, c in enumerate(word) if c.isalpha() or not c.isascii()), 0)
    capital = not word[first : first + 1].isascii() and word[first : first + 1].isupper() and not word[first + 1 : first + 2].isupper()
    return read[:first] + read[first : first + 1].upper() + read[first + 1 :] if capital else read


def _mixed(word: str) -> bool:
    """Capitals after small letters inside a word."""
    return any(a.islower() and b.isupper() for a, b in zip(word, word[1:]))


def _frequent(rows: DataFrame) -> tuple[DataFrame, pd.DataFrame]:
    """The staged counts, and the usual words that are at least ``SHARE`` of all: at most 1 / ``SHARE`` of them."""
    counted = stage(counts(rows))
    total = counted.agg(F.sum("n")).first()[0] or 0
    words = counted.where("low <> ''").groupBy(F.col("low").alias("token")).agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= max(LEAST, int(total * SHARE))).toPandas()
    return counted, frequent[np.array([all(c in USUAL and c != "\xa0" for c in w) for w in frequent.token], dtype=bool)]


def restored(documents: DataFrame, pages: bool = True, ciphered: bool = True) -> DataFrame:
    """(doc_id, text, changed) of every garbled document; without ``pages`` no single-byte code page is consulted."""
    spark = documents.sparkSession
    rows = documents.where("text is not null and text <> '' and doc_id is not null").select("doc_id", "text", "source")
    counted, clean = _frequent(rows)
    known = dict(zip(clean.token, clean.n.astype(int)))
    table: dict[str | None, dict[str, list[tuple[str, float]]]] = {}
    if ciphered:
        for r in mappings(contexts(counted, spark.sparkContext.broadcast(known)), clean).toLocalIterator():  # alphabets by sources
            table.setdefault(r.source, {}).setdefault(r.symbol, []).append((r.letter, r.p))
    for letters in table.values():
        for symbol in letters:
            letters[symbol].sort(key=lambda x: (-x[1], x[0]))
    tool = spark.sparkContext.broadcast(Reader(known, table, pages))

    def mend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = tool.value
        for frame in frames:
            done = [reader.text(t, s or "") for t, s in zip(frame.text, frame.source)]
            out = pd.DataFrame({"doc_id": frame.doc_id, "text": [t for t, _ in done], "garbled": [g for _, g in done]})
            yield out[out.garbled]

    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(mend, f"doc_id {kind}, text string, garbled boolean").dropDuplicates(["doc_id"])


def found(documents: DataFrame) -> DataFrame:
    return restored(documents).select("doc_id")


def texts(documents: DataFrame) -> DataFrame:
    """(doc_id, text): the garbled documents, restored where possible."""
    return restored(documents).select("doc_id", "text")


def ciphers(documents: DataFrame) -> DataFrame:
    """(source, symbol, letter, p, n): the likeliest letter of each symbol by source."""
    rows = documents.where("text is not null and text <> ''").select("doc_id", "text", "source")
    counted, clean = _frequent(rows)
    known = documents.sparkSession.sparkContext.broadcast(dict(zip(clean.token, clean.n.astype(int))))
    best = F.max_by(F.struct("letter", "p"), F.struct("p", "letter")).alias("b")
    learnt = mappings(contexts(counted, known), clean).where("source is not null").groupBy("source", "symbol").agg(best, F.sum("n").cast("bigint").alias("n"))
    return learnt.select("source", "symbol", "b.letter", "b.p", "n")
