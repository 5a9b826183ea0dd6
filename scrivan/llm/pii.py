"""Personal information in free text: a character BiLSTM with CRF transitions, in numpy.

The model reads every character of every text, in overlapping windows of ``WIDTH`` characters. Where windows overlap, the
scores of the one in which a character stands further from the edge count; then one best label sequence is decoded for
the whole text: places that no better sequence can label are told by a bound, the stretches between them are decoded. What the model labels is the value: its span is only completed to whole words (``snap``). No pattern
decides where the model looks, what is a value or where it ends; patterns only choose what it is trained on.

The weights in ``pii_model.npz`` were trained by ``pii_train.py`` on at most ``SAMPLE`` labelled texts.

Cases: null texts give no row, empty ones no value; repeated rows count once; values met twice in a text are one row;
empty tables give empty results; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("email", "phone", "id_number", "address", "person_name")
LABELS = ["O", *[f"{x}-{t}" for t in TYPES for x in "BI"]]
WIDTH, STEP, BATCH, SAMPLE = 1024, 960, 512, 2500
#: Characters whose scores are held at once (a longer text is held whole), and that are bounded at once (a longer text as well);
#: characters times stretches decoded at once.
HELD, BLOCK, DECODED = 3_000_000, 50_000, 500_000
MODEL = Path(__file__).with_name("pii_model.npz")

_ids: dict[str, int] = {}
_MARKS = " \n\t.,;:()[]/-+@_'\"|?!&%*=<>"


def char_id(ch: str) -> int:
    """A character by its plain letter, case and accent; digits are one; other characters by themselves or as one."""
    known = _ids.get(ch)
    if known is None:
        plain = unicodedata.normalize("NFKD", ch)[0]
        low = {"đ": "d", "Đ": "d"}.get(ch, plain).lower()
        if "a" <= low <= "z":
            known = 1 + (ord(low) - 97) * 4 + 2 * ch.isupper() + (not ch.isascii() and plain != ch or ch in "đĐ")
        elif ch.isdigit():
            known = 105
        elif ch in _MARKS:
            known = 106 + _MARKS.index(ch)
        elif ch.isspace():
            known = 106
        else:
            known = 106 + len(_MARKS) + (unicodedata.category(ch)[0] == "M")
        _ids[ch] = known
    return known


#: ``PAD`` fills windows up: it leaves the model's state at nothing, so a text's scores don't hang on those beside it.
N_CHARS = PAD = 110 + len(_MARKS)
_known = np.full(0x110000, -1, np.int16)


def encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ids = _known[codes]
    if (ids < 0).any():
        new = np.unique(codes[ids < 0])
        _known[new] = [char_id(chr(c)) for c in new.tolist()]
        ids = _known[codes]
    return ids


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def lstm(inputs: np.ndarray, weights: np.ndarray, keep: list | None = None) -> np.ndarray:
    """[T, B, 4H] projected inputs and [H, 4H] recurrent weights -> [T, B, H]; ``keep`` gets what training needs."""
    steps, batch, four = inputs.shape
    size = four // 4
    h = np.zeros((batch, size), np.float32)
    c = np.zeros((batch, size), np.float32)
    out = np.empty((steps, batch, size), np.float32)
    for t in range(steps):
        z = inputs[t] + h @ weights
        gates = _sigmoid(z[:, : 3 * size])
        g = np.tanh(z[:, 3 * size :])
        before = c
        c = gates[:, size : 2 * size] * c + gates[:, :size] * g
        tc = np.tanh(c)
        last, h = h, gates[:, 2 * size :] * tc
        out[t] = h
        if keep is not None:
            keep.append((gates, g, before, tc, last))
    return out


class Model:
    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        w = {k: v.astype(np.float32) for k, v in weights.items()}
        self.w = w
        self.gates = np.stack([_gates(w[f"{d}h"], w[f"{d}x"], w[f"{d}b"], w[f"o{d}"]) for d in "fb"])
        self.chars = np.zeros((w["emb"].shape[1] + 2, N_CHARS + 1), np.float32)
        self.chars[:-2, :N_CHARS], self.chars[-2, :N_CHARS], self.chars[-1, PAD] = w["emb"].T, 1, 1
        self.bound = _Bound(w["trans"])

    @classmethod
    def load(cls, path: Path = MODEL) -> Model:
        with np.load(path) as stored:
            return cls({k: stored[k] for k in stored.files})

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """[B, T] characters -> [B, T, labels] emission scores."""
        x = np.full((ids.shape[1], -(-len(ids) // 16) * 16), PAD, np.intp)  # whole vectors: rounding doesn't hang on the batch
        x[:, : len(ids)] = ids.T
        return _passed(self.gates, self.chars, self.w["bias"], x)[:, :, : len(ids)].transpose(2, 0, 1)


def _gates(recurrent: np.ndarray, inputs: np.ndarray, bias: np.ndarray, read: np.ndarray) -> np.ndarray:
    """[4H + labels, H + E + 2] weights of twice the state, a character's vector, one and ``PAD``, so that sigmoids come as tanh(z / 2); the last rows read a state."""
    size = len(recurrent)
    shut = np.zeros(4 * size, np.float32)
    shut[:size] = shut[2 * size : 3 * size] = -1000
    shut[3 * size :] = -bias[3 * size :]  # a shut gate may come as 1e-7: nothing is let in
    out = np.zeros((4 * size + read.shape[1], size + len(inputs) + 2), np.float32)
    out[: 4 * size] = np.concatenate([recurrent / 2, inputs, bias[None], shut[None]]).T
    out[: 3 * size] /= 2
    out[4 * size :, :size] = read.T / 2
    return out


def _proto(number: int, x: bytes | int) -> bytes:
    """A field of a protocol buffer, below 128 bytes."""
    return bytes([number << 3 | 2, len(x)]) + x if isinstance(x, bytes) else bytes([number << 3, x])


@functools.cache
def _session(op: bytes, *inputs: bytes):
    """One operator of onnxruntime on one core; None where it is not installed."""
    try:
        import onnxruntime
    except ImportError:
        return None
    array = lambda name: _proto(1, name) + _proto(2, _proto(1, _proto(1, 1)))
    node = b"".join(_proto(1, x) for x in inputs) + _proto(2, b"out") + _proto(4, op)
    graph = _proto(1, node) + _proto(2, b"graph") + b"".join(_proto(11, array(x)) for x in inputs) + _proto(12, array(b"out"))
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    return onnxruntime.InferenceSession(_proto(1, 8) + _proto(7, graph) + _proto(8, _proto(1, b"") + _proto(2, 13)), options, providers=["CPUExecutionProvider"])


def _filled(op: str, out: np.ndarray, *given: np.ndarray) -> Callable[[], object]:
    """What fills ``out`` by an operator (Tanh, MatMul) of arrays as they are then: by onnxruntime, whose tanh takes a
    sixth of numpy's time and its products four fifths where a processor has no AVX-512, or by numpy."""
    names = [b"a", b"b"][: len(given)]
    if (session := _session(op.encode(), *names)) is None:
        numpy = getattr(np, op.lower())
        return lambda: numpy(*given, out=out)
    bound = session.io_binding()
    for name, x in zip(names, given):
        bound.bind_input(name.decode(), "cpu", 0, np.float32, x.shape, x.ctypes.data)
    bound.bind_output("out", "cpu", 0, np.float32, out.shape, out.ctypes.data)
    return lambda: session.run_with_iobinding(bound)


def _passed(gates: np.ndarray, chars: np.ndarray, bias: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``lstm`` of [T, B] characters in both orders at once, read into [T, labels, B] scores.

    A gate is one tanh, 2 sigmoid(z) = tanh(z / 2) + 1. The product that makes a step's gates also reads the state before it.
    """
    (steps, batch), labels = x.shape, len(bias)
    size = (gates.shape[1] - labels) // 4
    step, c, tc = np.zeros((2, gates.shape[2], batch), np.float32), *np.zeros((2, 2, size, batch), np.float32)
    z = np.zeros((2, gates.shape[1], batch), np.float32)
    h, given, read = step[:, :size], step[:, size:], z[:, 4 * size :]
    i, f, o, g, sigmoids = z[:, :size], z[:, size : 2 * size], z[:, 2 * size : 3 * size], z[:, 3 * size : 4 * size], z[:, : 3 * size]
    product, gate, state = _filled("MatMul", z, gates, step), _filled("Tanh", z, z), _filled("Tanh", tc, c)
    scores, bias = np.empty((steps, labels, batch), np.float32), bias[:, None]
    for t in range(steps + 1):
        if t < steps:
            chars.take(x[t], axis=1, out=given[0], mode="clip")
            chars.take(x[-1 - t], axis=1, out=given[1], mode="clip")
        product()
        if t:
            np.add(read[0], bias if 2 * t <= steps + 1 else scores[t - 1], out=scores[t - 1])
            np.add(read[1], bias if 2 * t <= steps else scores[steps - t], out=scores[steps - t])
        gate()
        sigmoids += 1
        c *= f
        i *= g
        c += i
        c *= 0.5
        state()
        np.multiply(tc, o, out=h)
    return scores


class _Bound:
    """What a run of labels other than O can at most score above O, so that places outside any such run need no decoding.

    What going on from a value's first character scores above going on later is counted when that character is met.
    """

    def __init__(self, trans: np.ndarray) -> None:
        above = trans - trans[0, 0]
        ahead = np.zeros(len(trans), np.float32)
        for k in range(1, len(trans), 2):
            ahead[k] = max(0, above[k, k + 1] - np.delete(above[1:, k + 1], k - 1).max())
        above = above + ahead - ahead[:, None]
        self.enter, self.go, self.start = above[0, 1:, None], above[1:, 1:].max(axis=0)[:, None], ahead[1:, None]
        self.leave = float(above[1:, 0].max())

    def gains(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """[T, labels, B] scores -> [T, B] what a run can gain by beginning at a place after O, and by going on to it; [B] by beginning with a text."""
        begin, go = np.empty((2, len(scores), scores.shape[2]), np.float32)
        for t in range(0, len(scores), 16):
            others = scores[t : t + 16, 1:] - scores[t : t + 16, :1]
            np.max(others + self.enter, axis=1, out=begin[t : t + 16])
            others += self.go
            np.max(others, axis=1, out=go[t : t + 16])
        return begin, go, (scores[0, 1:] + self.start).max(axis=0) - scores[0, 0]

    def open(self, begin: np.ndarray, go: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The places that may lie in such a run; ``last``: a text's last ones, where none has to leave."""
        v = np.cumsum(go, dtype=np.float64)
        ends = v + np.where(last, 0, self.leave)
        most = np.maximum.accumulate(begin - v) + np.maximum.accumulate(ends[::-1])[::-1]
        most += go
        most += 0.01  # rounding
        return most >= 0


def viterbi(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """[B, T, L] -> [B, T] best labels."""
    batch, steps, size = scores.shape
    free = np.zeros((size, batch), np.float32)
    return _best(scores.transpose(1, 2, 0).astype(np.float32, order="C"), np.full(batch, steps), free, free, trans)


def _best(best: np.ndarray, lengths: np.ndarray, first: np.ndarray, last: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """[T, L, B] scores of sequences of falling lengths, [L, B] for their first and last labels -> [B, T]. Overwrites ``best``."""
    steps, size, batch = best.shape
    live = np.searchsorted(-lengths, -np.arange(steps + 1))  # sequences longer than t
    top, other = np.empty((2, size, batch), np.float32)
    best[0] += first
    for t in range(1, steps):
        n = live[t]
        a, b = top[:, :n], other[:, :n]
        np.add(best[t - 1, 0, :n], trans[0][:, None], out=a)
        for k in range(1, size):
            np.maximum(a, np.add(best[t - 1, k, :n], trans[k][:, None], out=b), out=a)
        best[t, :, :n] += a
    out = np.zeros((steps, batch), np.int8)
    for t in range(steps - 1, -1, -1):  # where each best label came from is only asked for those on the path
        n, on = live[t], live[t + 1]
        if on:
            out[t, :on] = (best[t, :, :on] + trans[:, out[t + 1, :on]]).argmax(axis=0)
        if on < n:
            out[t, on:n] = (best[t, :, on:n] + last[:, on:n]).argmax(axis=0)
    return out.T


_UP = "A-Z" + "".join(chr(c) for c in [*range(0xC0, 0x250), *range(0x1EA0, 0x1EFA), *range(0xFF21, 0xFF3B)] if chr(c).isupper())
# each begins with one class of characters: the search for that is fast
_SIGN = re.compile(r"[@\[(](?:at[\])])?")
_DIGITS = re.compile(r"[\d０-９](?:[\s.\-()]{0,2}[\d０-９lOoISB]){7}")
_NO_NUMBER = re.compile(r"\d{4}-\d{4}(?![\d\-])|[1-9]\d{0,2}(?:\.\d{3}){1,3}(?![\d.])")  # two years, or an amount
_CAPITALS = re.compile(rf"[{_UP}][^\W\d_]*[\u0300-\u036f]*[^\W\d_]*\.?\s+[{_UP}]")
BEFORE, AFTER = 36, 24


def stretches(text: str) -> list[tuple[int, int]]:
    """The places of a text that the model is trained on: those that can hold a value, with what stands beside them."""
    marks = [m.span() for m in _CAPITALS.finditer(text)]
    marks += [m.span() for m in _DIGITS.finditer(text) if not _NO_NUMBER.match(text, m.start())]
    if "@" in text or "at" in text:
        marks += [m.span() for m in _SIGN.finditer(text) if m.group() not in "[("]
    marks.sort()
    out: list[tuple[int, int]] = []
    for start, end in marks:
        a, b = max(0, start - BEFORE), min(len(text), end + AFTER)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def label_stretches(model: Model, parts: list[str]) -> list[np.ndarray]:
    """The labels of every character of every part. Windows overlap; the inner scores count; decoding is global."""
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(parts)
    order = sorted(range(len(parts)), key=lambda k: len(parts[k]))  # windows beside each other are about as long
    ends = np.cumsum([len(parts[k]) for k in order])
    start = 0
    while start < len(parts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + HELD, "right")))
        for k, labels in zip(order[start:stop], _labelled(model, [parts[k] for k in order[start:stop]])):
            out[k] = labels
        start = stop
    return out


def _labelled(model: Model, parts: list[str]) -> list[np.ndarray]:
    lengths = np.array([len(p) for p in parts])
    starts = np.cumsum(lengths + 1) - lengths - 1  # all texts in one row, with a place between
    ids = encode("\n".join([*parts, ""]))
    # windows: text, place in it, length, and from where to where its scores count
    many = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WIDTH) // STEP)), 0)
    text = np.repeat(np.arange(len(parts)), many)
    at = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * STEP
    long = np.minimum(WIDTH, lengths[text] - at)
    low, high = np.where(at > 0, (WIDTH - STEP) // 2, 0), np.where(at + long < lengths[text], WIDTH - (WIDTH - STEP) // 2, long)
    base = starts[text] + at
    begin, go, last = np.full(len(ids), -1e3, np.float32), np.full(len(ids), -1e3, np.float32), np.zeros(len(ids), bool)
    last[(starts + lengths - 1)[lengths > 0]] = True
    order, held = np.argsort(long, kind="stable"), []
    for w in np.array_split(order, -(-len(order) // BATCH) or 1)[: len(order)]:
        t = np.arange(long[w].max())[:, None]
        place = np.minimum(base[w] + t, len(ids) - 1)
        got = model.scores(np.where(t < long[w], ids[place], PAD).T).transpose(1, 2, 0)
        counts = (t >= low[w]) & (t < high[w])
        enters, goes, whole = model.bound.gains(got)
        here = place[counts]
        begin[here], go[here] = enters[counts], goes[counts]
        first = at[w] == 0
        begin[base[w][first]] = np.maximum(begin[base[w][first]], whole[first])
        held.append((place, counts, got))
    cuts = [*starts[np.unique(starts // BLOCK, return_index=True)[1]].tolist(), len(ids)]
    maybe = np.concatenate([model.bound.open(begin[a:b], go[a:b], last[a:b]) for a, b in itertools.pairwise(cuts)])
    maybe[starts + lengths] = False
    where = np.flatnonzero(maybe)
    rank = np.cumsum(maybe) - 1
    scores = np.empty((len(where), len(LABELS)), np.float32)
    for place, counts, got in held:
        t, b = np.nonzero(counts & maybe[place])
        scores[rank[place[t, b]]] = got[t, :, b]
    labels = np.zeros(len(ids), np.int8)
    labels[where] = _decoded(model.w["trans"], scores, where, np.isin(where, starts), last[where])
    return [labels[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist())]


def _decoded(trans: np.ndarray, scores: np.ndarray, where: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """The best labels of [places, labels] scores: of each stretch of neighbours, with O beside it where its text goes on."""
    out = np.zeros(len(where), np.int8)
    starts = np.flatnonzero(np.diff(where, prepend=-2) > 1)
    lengths = np.diff(starts, append=len(where))
    order = np.argsort(-lengths, kind="stable")
    while len(order):
        chosen = order[: max(1, DECODED // int(lengths[order[0]]))]
        order = order[len(chosen) :]
        n, t = lengths[chosen], np.arange(lengths[chosen[0]])[:, None]
        place = np.minimum(starts[chosen] + t, len(where) - 1)
        first = np.where(opens[starts[chosen]], 0, trans[0][:, None]).astype(np.float32)
        last = np.where(closes[starts[chosen] + n - 1], 0, trans[:, :1]).astype(np.float32)
        got = _best(np.ascontiguousarray(scores[place].transpose(0, 2, 1)), n, first, last, trans).T
        out[place[t < n]] = got[t < n]
    return out


def spans_of(labels: np.ndarray) -> list[tuple[str, int, int]]:
    out, at = [], 0
    edge = np.flatnonzero(labels)
    n = len(labels)
    while len(edge):
        at = int(edge[0])
        kind = (labels[at] - 1) // 2
        end = at + 1
        while end < n and labels[end] and (labels[end] - 1) // 2 == kind and labels[end] % 2 == 0:
            end += 1
        out.append((TYPES[kind], at, end))
        edge = edge[edge >= end]
    return out


def _clear(value: str) -> str:
    return re.sub(r"\s*\n\s*", " ", value)


_TRIM = " \t\r\n.,;:!?\"'|"
#: Words that begin the name of a body, never a person's.
_BODIES = {"trường", "đại", "khoa", "phòng", "viện", "ban", "university", "college", "school", "faculty"}
_IN_MAIL = re.compile(r"[\w.+\-]")
_DIGIT = re.compile(r"\d")


def snap(kind: str, text: str, a: int, b: int) -> tuple[int, int] | None:
    """The model's span on whole words: cut words are completed, blanks and marks at the ends left out.

    A value that can't be one of its type (a mail address without a sign, a number of too few or too many digits, two
    years, an amount, a name of one word or of words without capitals) is none.
    """
    more = _IN_MAIL.match if kind == "email" else str.isalnum
    while a > 0 and more(text[a - 1]) and more(text[a]):
        a -= 1
    while b < len(text) and more(text[b - 1]) and more(text[b]):
        b += 1
    while a < b and text[a] in _TRIM:
        a += 1
    while b > a and text[b - 1] in _TRIM and not (kind == "person_name" and text[b - 1] == "." and text[b - 2 : b - 1].isupper() and not text[b - 3 : b - 2].isalnum()):
        b -= 1
    if kind == "phone" and text[a:b].count(")") > text[a:b].count("(") and text[a - 1 : a] == "(":
        a -= 1
    if kind == "person_name":  # every word of a name has a capital
        words = list(re.finditer(r"\S+", text[a:b]))
        kept = next((k for k, w in enumerate(words) if not w.group()[0].isupper()), len(words))
        b = a + words[kept - 1].end() if kept and words[0].group().lower() not in _BODIES else a
    value = text[a:b]
    if kind in ("phone", "id_number") and _NO_NUMBER.fullmatch(value):
        return None
    digits = len(_DIGIT.findall(value))
    if kind == "email":
        whole = "@" in value or "at" in value
    elif kind == "phone":
        whole = 8 <= digits <= 15
    elif kind == "id_number":
        whole = 7 <= digits <= 12
    elif kind == "address":
        whole = digits > 0 and " " in value
    else:
        whole = len(value.split()) > 1 and not digits and value[0].isupper()
    return (a, b) if whole else None


def texts_of(results: DataFrame) -> DataFrame:
    """(ocr_id, field_name, body): both text columns, without repeated rows."""
    rows = results.where("id is not null").select("id", "raw_text", "corrected_text").dropDuplicates(["id"])
    both = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("body")) for c in ("raw_text", "corrected_text")])
    return rows.select(F.col("id").alias("ocr_id"), F.inline(both)).where("body is not null and body <> ''")


def find(model: Model, bodies: list[str]) -> list[list[tuple[str, int, int]]]:
    """The values of each text: (type, begin, end)."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in bodies]
    for taken, body, ls in zip(out, bodies, label_stretches(model, bodies)):
        for kind, s, e in spans_of(ls):
            got = snap(kind, body, s, e)
            if got and not any(got[0] < y and x < got[1] for _, x, y in taken):
                taken.append((kind, *got))
    return out


def tagged(results: DataFrame, mask: bool = True) -> DataFrame:
    """(ocr_id, field_name, text, found): each text with placeholders (null without ``mask``), and the values with their types."""
    blob = results.sparkSession.sparkContext.broadcast(MODEL.read_bytes())  # some tens of KB

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        with np.load(io.BytesIO(blob.value)) as stored:
            model = Model({k: stored[k] for k in stored.files})
        for frame in frames:
            bodies = frame.body.tolist()
            texts, found = [], []
            for body, spans in zip(bodies, find(model, bodies)):
                pieces, end, mine = [], 0, set()
                for kind, a, b in sorted(spans, key=lambda s: s[1]):
                    pieces += [body[end:a], f"<{kind.upper()}>"]
                    end = b
                    mine.add((kind, _clear(body[a:b])))
                texts.append("".join([*pieces, body[end:]]) if mask else None)
                found.append([{"pii_type": k, "pii_value": v} for k, v in sorted(mine)])
            yield pd.DataFrame({"ocr_id": frame.ocr_id, "field_name": frame.field_name, "text": texts, "found": found})

    return texts_of(results).mapInPandas(run, "ocr_id string, field_name string, text string, found array<struct<pii_type:string,pii_value:string>>")


def found(results: DataFrame) -> DataFrame:
    """(ocr_id, field_name, pii_type, pii_value)"""
    return tagged(results, mask=False).select("ocr_id", "field_name", F.inline("found"))


def masked(results: DataFrame) -> DataFrame:
    """(ocr_id, field_name, text): each text with typed placeholders."""
    return tagged(results).select("ocr_id", "field_name", "text")
