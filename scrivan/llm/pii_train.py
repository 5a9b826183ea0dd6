"""Trains ``pii_model.npz``: ``python -m scrivan.llm.pii_train <ocr_results.parquet>``.

Labelled spans come from at most ``SAMPLE`` texts, labelled by cues (what stands before and after a value) and the
values' forms, with family names learnt from the cues. Labelled values are then replaced by made ones of forms that the
labeller doesn't know (other mail domains, foreign numbers, other address orders, longer names), and capitalised pairs
that are nobody's name are put between; misreadings and line breaks are varied, so that the model learns values from
their surroundings and shape rather than the labeller's patterns.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

import numpy as np

from scrivan.llm import pii
from scrivan.llm.pii import _UP, LABELS, MODEL, N_CHARS, SAMPLE, TYPES, Model, encode, lstm, spans_of, viterbi

# ---- the labeller: how values are written in the training texts ----
_D = r"[\d０-９lOoISB]"
_PLACE = rf"[{_UP}][^\W\d_]*(?:\s[{_UP}][^\W\d_]*){{0,3}}"
_TOWN = rf"[{_UP}][^\W\d_]*\s[{_UP}][^\W\d_]*"
_HOUSE = r"\d{1,4}\s?[A-Z]?(?:/\d{1,4}[A-Z]?)?"
SHAPES = {
    "email": re.compile(r"(?i)(?:mailto:\s?)?[\w.+\-]+\s?(?:@|\[at\]|\(at\))\s?[\w\-]+(?:\s?[.．]\s?[\w\-]+)*\s?(?:[.．]|\[dot\]|\(dot\))\s?(?:example|test|invalid|vn|com|org|net|edu)\b(?:\.(?:vn|edu))?"),
    "phone": re.compile(rf"(?<![\w.\-/])(?:\(\s?\+\s?84\s?\)|\+\s?84|0084|0){{1}}(?:[\s.\-]{{0,2}}{_D}){{9}}(?![\w]|[.\-/]\d)"),
    "id_number": re.compile(rf"(?<![\w.\-/+])(?:{_D}{{12}}|{_D}{{3}}(?:[\s.\-]{_D}{{3}}){{3}}|{_D}{{9}}|{_D}{{3}}[\s.\-]{_D}{{3}}[\s.\-]{_D}{{3}}|{_D}{{8}}|{_D}{{4}}\s{_D}{{4}})(?![\w]|[.\-/]\d)"),
    "address": re.compile(
        rf"(?i:thôn|ấp|tổ|hamlet|xóm|buôn)\s\d{{1,3}},\s(?i:xã)\s{_TOWN}(?:,\s(?i:huyện)\s{_TOWN})?"
        rf"|(?i:phòng|room|p\.)\s\d{{1,4}}[A-Z]?,\s(?i:nhà|block|building)\s\w{{1,3}},\s{_PLACE}(?:,\s{_TOWN})?"
        rf"|(?:(?i:số|no\.)\s)?{_HOUSE},?\s(?:(?i:đường|hẻm|ngõ|phố)\s)?{_PLACE},\s(?:(?i:phường|xã)|P\.)\s?{_TOWN}(?:,\s(?:(?i:thành\sphố|huyện|quận|thị\sxã)|TP\.?|Q\.|H\.)\s?{_TOWN})?"
    ),
}
_WORDS = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*\.?")
_FURNITURE = {"affairs", "student", "university", "quét", "bản", "tác", "công", "phòng", "lâm", "sinh", "viên", "trữ", "lưu"}
_TITLES = {"thầy", "cô", "ông", "bà", "anh", "chị", "em", "mr", "mrs", "ms", "dr", "ts", "ths", "gs", "pgs", "contact", "applicant", "thay", "co"}


def settle(kind: str, text: str, a: int, b: int) -> tuple[int, int] | None:
    """Where the value that the model saw at [a, b) begins and ends by the form of its type; none if it has no such form."""
    if kind == "person_name":
        return _settle_name(text, a, b)
    low = max(0, a - 60)
    best = None
    for m in SHAPES[kind].finditer(text, low, min(len(text), b + 60)):
        both = min(m.end(), b) - max(m.start(), a)
        if both > 0 and (best is None or both > best[0]):
            best = (both, m.start(), m.end())
    if best is None:
        return None
    _, a, b = best
    digits = sum(c.isdigit() for c in text[a:b])
    if kind == "id_number" and digits < 7 or kind == "phone" and digits < 8:
        return None
    if kind == "id_number" and re.search(r"(?i)(giao dịch|hồ sơ|tài khoản|phiếu|hóa đơn|file|transaction)\W{0,3}(số|no\.?|id)?\W{0,3}$", text[max(0, a - 24) : a]):
        return None
    return a, b


def _joins(text: str, one: tuple[int, int, str], two: tuple[int, int, str]) -> bool:
    ended = one[2].endswith(".") and len(one[2]) > 2
    return text[one[1] : two[0]] == " " and not ended and one[2][0].isupper() and two[2][0].isupper() and (one[0] == 0 or not text[one[0] - 1].isalnum())


def _settle_name(text: str, a: int, b: int) -> tuple[int, int] | None:
    """Two to four whole capitalised words, without a title; the line of an entry holds the whole name."""
    around = [(m.start(), m.end(), m.group()) for m in _WORDS.finditer(text, max(0, a - 24), min(len(text), b + 24))]
    inside = [k for k, w in enumerate(around) if w[1] > a and w[0] < b]
    if not inside:
        return None
    first, last = inside[0], inside[-1]
    # capitalised words beside, on the same line, are of the name
    while last - first < 3 and first and _joins(text, around[first - 1], around[first]) and around[first - 1][2].lower() not in _TITLES:
        first -= 1
    while last - first < 3 and last + 1 < len(around) and _joins(text, around[last], around[last + 1]):
        last += 1
    words = around[first : last + 1]
    # a word cut at the window's edge is no word
    while words and (words[0][0] > 0 and text[words[0][0] - 1].isalnum()):
        words.pop(0)
    while words and (words[0][2].rstrip(".").lower() in _TITLES or not words[0][2][0].isupper()):
        words.pop(0)
    # a header line above is none of the name
    for k in range(len(words) - 1, 0, -1):
        if "\n" in text[words[k - 1][1] : words[k][0]] and words[k - 1][2].lower() in _FURNITURE:
            words = words[k:]
            break
    kept = words[:1]
    for w in words[1:4]:
        between = text[kept[-1][1] : w[0]]
        ended = kept[-1][2].endswith(".") and len(kept[-1][2]) > 2
        if not w[2][0].isupper() or between.strip() or ended or between.count("\n") > 1:
            break
        if "\n" in between and len(kept) > 1 and re.search(r"(?:Người\s+\w+|Họ\s+và\s+tên)\s*:\s*$", text[max(0, kept[0][0] - 30) : kept[0][0]]):
            break
        kept.append(w)
    if len(kept) < 2 or (kept[-1][1] < len(text) and text[kept[-1][1]].isalnum()):
        return None
    start, end = kept[0][0], kept[-1][1]
    if text[end - 1] == "." and len(kept[-1][2]) > 2:
        end -= 1
    if any(c.isdigit() for c in text[start:end]) or re.search(r"(?i)sương\s+lâm|suong\s+lam|đại\s+học", text[start:end]):
        return None
    return start, end


#: Characters of a training window.
TRAINED = 128
_NAME = rf"[{_UP}][^\W\d_]*\.?(?:\s[{_UP}][^\W\d_]*\.?){{1,4}}"
CUES = [
    re.compile(rf"(?:Người\s(?:ký|nộp\shồ\ssơ)|Họ\svà\stên)\s?:\s({_NAME})"),
    re.compile(rf"(?:Liên\shệ|tên\slà|Contact|Applicant|Thầy|Cô|Ông|Bà|Signed\sby)\s({_NAME})"),
    re.compile(rf"({_NAME})\s(?:đã\snộp|signed\sthe|lives\sat)"),
]


def surnames(texts: list[str]) -> set[str]:
    seen = Counter(m.group(1).split()[0].rstrip(".").lower() for t in texts for cue in CUES for m in cue.finditer(t))
    return {s for s, n in seen.items() if n >= 5 and len(s) > 1} - _TITLES


def label(text: str, family: set[str]) -> list[tuple[str, int, int]]:
    """Labelled spans of a text."""
    spans: list[tuple[str, int, int]] = []

    def add(kind: str, a: int, b: int) -> None:
        got = settle(kind, text, a, b)
        if got and not any(got[0] < y and x < got[1] for _, x, y in spans):
            spans.append((kind, *got))

    for kind in ("email", "phone", "address", "id_number"):
        for m in SHAPES[kind].finditer(text):
            add(kind, m.start(), m.end())
    for cue in CUES:
        for m in cue.finditer(text):
            add("person_name", *m.span(1))
    for m in re.finditer(_NAME, text):
        words = [(w.start() + m.start(), w.group()) for w in re.finditer(r"\S+", m.group())]
        for k, (at, w) in enumerate(words[:-1]):
            if w.lower() in family:
                add("person_name", at, m.end())
                break
    return spans


class Maker:
    """Values of many forms, for training."""

    PLACES = "Lê Lợi|Nguyễn Trãi|Trần Phú|Hai Bà Trưng|Phan Đình Phùng|Hoàng Diệu|Đống Đa|Cầu Giấy|Tân Bình|Đức Trọng|Di Linh|Bảo Lộc|Đà Lạt|Nha Trang|Hải Châu|Thanh Khê|Ba Đình|Bình Thạnh|Gò Vấp|Lâm Đồng|Hà Nội|Đà Nẵng|Khánh Hòa|Hồ Chí Minh".split("|")
    FAMILIES = "Nguyễn|Trần|Lê|Phạm|Hoàng|Huỳnh|Phan|Vũ|Võ|Đặng|Bùi|Đỗ|Hồ|Ngô|Dương|Lý|Smith|Brown|Martin|Dubois|Chen|Kim".split("|")
    GIVEN = "Văn|Thị|Minh|Ngọc|Hữu|Thanh|Quốc|Gia|Bảo|Anh|Hà|Lan|Hùng|Dũng|Mai|Trang|Phương|Tùng|Khánh|Linh|Thu|John|Mary|Peter|Anna|Paul".split("|")
    NOT_NAMES = "Baker Street|Main Road|King Avenue|Hội trường Lớn|Central Library|Open University|Học kỳ Hai|Ban Giám hiệu|Khoa Công nghệ|Trung tâm Tin học|Green Park|South Bridge|Bộ Giáo dục|Văn phòng Đoàn|Data Science|North Campus".split("|")

    def __init__(self, rng: np.random.Generator, known: dict[str, list[str]]) -> None:
        self.rng, self.known = rng, known

    def one(self, of):
        return of[int(self.rng.integers(0, len(of)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def letters(self, low: int, high: int) -> str:
        return "".join(self.one("abcdefghijklmnopqrstuvwxyz") for _ in range(int(self.rng.integers(low, high))))

    def digits(self, n: int) -> str:
        return "".join(self.one("0123456789") for _ in range(n))

    def email(self) -> str:
        user = self.letters(1, 9) + (self.one("._-+") + self.letters(1, 7) if self.chance(0.5) else "") + (self.digits(2) if self.chance(0.3) else "")
        at = "@" if self.chance(0.8) else self.one([" @ ", "[at]", " [at] ", "(at)", "@ "])
        host = ".".join(self.letters(2, 9) for _ in range(int(self.rng.integers(1, 3))))
        return f"{user}{at}{host}.{self.one(['vn', 'com', 'info', 'io', 'org', 'net', 'eu', 'fr', 'dev', 'edu.vn', 'co.uk', self.letters(2, 5)])}"

    def phone(self) -> str:
        gap = self.one([" ", ".", "-", "", " "])
        if self.chance(0.5):
            return gap.join([self.one(["+44", "+1", "+33", "+49", "+82", "+61"]), self.digits(int(self.rng.integers(2, 4))), self.digits(int(self.rng.integers(3, 5))), self.digits(4)])
        head = self.one(["0", "+84 ", "(+84) ", "0084 "]) + self.one("35789") + self.digits(1)
        return head + self.digits(1) + gap + self.digits(3) + gap + self.digits(3) if self.chance(0.5) else head + gap + self.digits(3) + gap + self.digits(4)

    def id_number(self) -> str:
        return self.one([self.digits(12), self.digits(9), self.digits(8), " ".join(self.digits(3) for _ in range(4)), ".".join(self.digits(3) for _ in range(3))])

    def address(self) -> str:
        n = lambda top: str(int(self.rng.integers(1, top)))
        parts = []
        house = n(400) + (self.one("ABC") if self.chance(0.2) else "") + (f"/{n(60)}" if self.chance(0.3) else "")
        street = self.one(self.PLACES) if self.chance(0.7) else " ".join([self.one(self.FAMILIES[:16]), self.one(self.GIVEN[:20])])
        if self.chance(0.35):
            parts += [self.one(["Số ", "số ", "No. ", ""]) + house, f"{self.one(['ngách', 'ngõ', 'hẻm', 'kiệt'])} {n(90)}" + (f"/{n(20)}" if self.chance(0.5) else ""), f"{self.one(['đường', 'phố'])} {street}"]
        else:
            parts.append(self.one(["Số ", "số ", "", "", "No. "]) + house + self.one([" ", ", ", " đường ", " phố ", " "]) + street)
        if self.chance(0.6):
            parts.append(self.one(["Phường ", "phường ", "P. ", "xã ", "Xã "]) + (n(20) if self.chance(0.4) else self.one(self.PLACES)))
        if self.chance(0.5):
            parts.append(self.one(["Quận ", "quận ", "Q. ", "huyện ", "thị xã "]) + (n(12) if self.chance(0.3) else self.one(self.PLACES)))
        if self.chance(0.6) or len(parts) < 2:
            parts.append(self.one(["", "", "TP. ", "Thành phố ", "thành phố ", "tỉnh "]) + self.one(self.PLACES))
        return ", ".join(parts)

    def person_name(self) -> str:
        many = int(self.rng.integers(2, 7))
        words = [w for name in [self.one(self.known["person_name"]) for _ in range(2)] for w in name.split()] if self.known.get("person_name") and self.chance(0.5) else []
        return " ".join(([self.one(self.FAMILIES)] if not words else []) + (words + [self.one(self.GIVEN) for _ in range(6)]))[:60].rsplit(" ", 1)[0] if many > 5 else " ".join([self.one(self.FAMILIES), *[self.one(self.GIVEN) for _ in range(many - 1)]])

    def changed(self, text: str, spans: list[tuple[str, int, int]], share: float) -> tuple[str, list[tuple[str, int, int]]]:
        """A text with a share of its values replaced, and where they are now."""
        out, moved, at = [], [], 0
        for kind, a, b in sorted(spans, key=lambda s: s[1]):
            out.append(text[at:a])
            value = getattr(self, kind)() if self.chance(share) else text[a:b]
            begin = sum(map(len, out))
            out.append(value)
            moved.append((kind, begin, begin + len(value)))
            if self.chance(0.08):
                out.append(self.one([", ", " ở ", " – "]) + self.one(self.NOT_NAMES))
            if self.chance(0.1):
                out.append(self.no_value())
            at = b
        return "".join([*out, text[at:]]), moved

    def no_value(self) -> str:
        """What looks like a number or a name and is none."""
        year = int(self.rng.integers(2015, 2028))
        return self.one([", ", "\n", ". "]) + self.one([f"năm học {year}-{year + 1}", f"học kỳ II năm\n{year}-{year + 1}", f"Mã giao dịch: {self.digits(14)}", f"Mã hồ sơ {self.digits(11)}", f"Phiếu thu số {self.digits(4)}/{year}", "Hồ sơ lưu trữ\n", "HỒ SƠ LƯU TRỮ\n", "Thông báo\nsố"])


def windows(texts: list[str], family: set[str], rng: np.random.Generator, share: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    xs, ys = [], []
    labelled = [(t, label(t, family)) for t in texts]
    known: dict[str, list[str]] = {}
    for t, spans in labelled:
        for kind, a, b in spans:
            known.setdefault(kind, []).append(t[a:b])
    maker = Maker(rng, known)
    for text, spans in labelled:
        if share:
            text, spans = maker.changed(text, spans, share)
        y = np.zeros(len(text), np.int8)
        for kind, a, b in spans:
            k = TYPES.index(kind)
            y[a:b] = 2 + 2 * k
            y[a] = 1 + 2 * k
        for a, b in pii.stretches(text):
            shift = int(rng.integers(0, 30))
            for at in range(max(0, a - shift), b, TRAINED - 30):
                piece, lab = text[at : at + TRAINED], y[at : at + TRAINED]
                if len(piece) < 20:
                    continue
                piece = vary(piece, lab, rng)
                x = np.zeros(TRAINED, np.int16)
                x[: len(piece)] = encode(piece)
                z = np.zeros(TRAINED, np.int8)
                z[: len(piece)] = lab
                if z[0] and z[0] % 2 == 0:
                    z[0] -= 1
                xs.append(x)
                ys.append(z)
    return np.array(xs), np.array(ys)


def vary(piece: str, lab: np.ndarray, rng: np.random.Generator) -> str:
    chars = list(piece)
    for k, c in enumerate(chars):
        r = rng.random()
        if c == " " and r < 0.05:
            chars[k] = "\n"
        elif r < 0.006 and c.isalnum():
            chars[k] = {"0": "O", "1": "l", "l": "1", "o": "0", "5": "S", "i": "l", "h": "b"}.get(c, c)
    return "".join(chars)


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def crf(scores: np.ndarray, trans: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss of a batch, with the gradients of scores and transitions, by forward and backward sums."""
    batch, steps, size = scores.shape
    rows = np.arange(batch)
    alpha = np.empty_like(scores)
    beta = np.zeros_like(scores)
    alpha[:, 0] = scores[:, 0]
    for t in range(1, steps):
        alpha[:, t] = logsum(alpha[:, t - 1][:, :, None] + trans, 1) + scores[:, t]
    for t in range(steps - 2, -1, -1):
        beta[:, t] = logsum(trans + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    whole = logsum(alpha[:, -1], 1)
    grad = np.exp(alpha + beta - whole[:, None, None])
    pair = np.zeros_like(trans)
    for t in range(1, steps):
        pair += np.exp(alpha[:, t - 1][:, :, None] + trans + (scores[:, t] + beta[:, t])[:, None, :] - whole[:, None, None]).sum(axis=0)
    gold = scores[:, 0][rows, y[:, 0]].copy()
    for t in range(steps):
        grad[rows, t, y[:, t]] -= 1
        if t:
            gold += trans[y[:, t - 1], y[:, t]] + scores[rows, t, y[:, t]]
            np.subtract.at(pair, (y[:, t - 1], y[:, t]), 1)
    return float((whole - gold).mean()), grad / batch, pair / batch


def back(grad: np.ndarray, kept: list, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of an LSTM's projected inputs and recurrent weights."""
    steps, batch, size = grad.shape
    dz = np.empty((steps, batch, 4 * size), np.float32)
    dw = np.zeros_like(weights)
    dh = np.zeros((batch, size), np.float32)
    dc = np.zeros((batch, size), np.float32)
    for t in range(steps - 1, -1, -1):
        gates, g, before, tc, last = kept[t]
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - tc * tc)
        z = dz[t]
        z[:, :size] = dc * g * i * (1 - i)
        z[:, size : 2 * size] = dc * before * f * (1 - f)
        z[:, 2 * size : 3 * size] = dh * tc * o * (1 - o)
        z[:, 3 * size :] = dc * i * (1 - g * g)
        dw += last.T @ z
        dh = z @ weights.T
        dc = dc * f
    return dz, dw


def train(xs: np.ndarray, ys: np.ndarray, hidden: int = 20, width: int = 14, steps: int = 1200, batch: int = 96, seed: int = 1, say=print, start: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    w = {"emb": init(N_CHARS, width) * 2, "fx": init(width, 4 * hidden), "bx": init(width, 4 * hidden), "fh": init(hidden, 4 * hidden), "bh": init(hidden, 4 * hidden)}
    w |= {"fb": np.zeros(4 * hidden, np.float32), "bb": np.zeros(4 * hidden, np.float32), "of": init(hidden, len(LABELS)), "ob": init(hidden, len(LABELS)), "bias": np.zeros(len(LABELS), np.float32), "trans": np.zeros((len(LABELS), len(LABELS)), np.float32)}
    w["fb"][hidden : 2 * hidden] = w["bb"][hidden : 2 * hidden] = 1
    if start:
        w = {k: start[k].astype(np.float32) for k in w}
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(xs), batch)
        x, y = xs[pick].T, ys[pick]
        emb = w["emb"][x]
        keep_f: list = []
        keep_b: list = []
        f = lstm(emb @ w["fx"] + w["fb"], w["fh"], keep_f)
        b = lstm((emb @ w["bx"] + w["bb"])[::-1], w["bh"], keep_b)[::-1]
        scores = (f @ w["of"] + b @ w["ob"] + w["bias"]).transpose(1, 0, 2)
        loss, ds, dt = crf(scores, w["trans"], y)
        ds = ds.transpose(1, 0, 2).astype(np.float32)
        flat = ds.reshape(-1, len(LABELS))
        grad = {"trans": dt, "bias": flat.sum(axis=0), "of": f.reshape(-1, hidden).T @ flat, "ob": b.reshape(-1, hidden).T @ flat}
        zf, grad["fh"] = back(ds @ w["of"].T, keep_f, w["fh"])
        zb, grad["bh"] = back((ds @ w["ob"].T)[::-1], keep_b, w["bh"])
        zb = zb[::-1]
        e = emb.reshape(-1, width)
        grad["fx"], grad["bx"] = e.T @ zf.reshape(-1, 4 * hidden), e.T @ zb.reshape(-1, 4 * hidden)
        grad["fb"], grad["bb"] = zf.sum(axis=(0, 1)), zb.sum(axis=(0, 1))
        de = zf @ w["fx"].T + zb @ w["bx"].T
        grad["emb"] = np.zeros_like(w["emb"])
        np.add.at(grad["emb"], x.reshape(-1), de.reshape(-1, width))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.012 * min(1, step / 50) * (1 - step / steps) ** 0.7 + 1e-5
        for k, g in grad.items():
            g = g * min(1, 5 / norm)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        if step % 100 == 0:
            say(step, round(loss, 3))
    return w


def accuracy(w: dict[str, np.ndarray], xs: np.ndarray, ys: np.ndarray) -> dict[str, tuple[float, float]]:
    """Precision and recall of exact spans by type."""
    model = Model(w)
    out = Counter()
    for at in range(0, len(xs), 512):
        got = viterbi(model.scores(xs[at : at + 512]), model.w["trans"])
        for g, y in zip(got, ys[at : at + 512]):
            a, b = set(spans_of(g)), set(spans_of(y))
            for kind, *_ in a:
                out["got", kind] += 1
            for kind, *_ in b:
                out["want", kind] += 1
            for kind, *_ in a & b:
                out["both", kind] += 1
    return {t: (out["both", t] / max(1, out["got", t]), out["both", t] / max(1, out["want", t])) for t in TYPES}


SHOW = False


def main(path: str, steps: str = "1500", warm: str = "") -> None:
    import pyarrow.parquet as pq

    rng = np.random.default_rng(7)
    table = pq.read_table(path, columns=["raw_text", "corrected_text"]).to_pandas()
    texts = [t for c in ("raw_text", "corrected_text") for t in table[c] if t]
    pick = rng.permutation(len(texts))[: SAMPLE + 300]
    texts = [texts[k] for k in pick]
    family = surnames(texts[:SAMPLE])
    parts = [windows(texts[:SAMPLE], family, rng, share) for share in (0.0, 0.0, 0.3, 1.0)]
    xs, ys = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    print(len(xs), "windows,", sorted(family))
    w = train(xs, ys, steps=int(steps), start=Model.load().w if warm else None)
    for share in (0.0, 1.0):
        print(share, accuracy(w, *windows(texts[SAMPLE:], family, rng, share)))
    np.savez_compressed(MODEL, **{k: v.astype(np.float16) for k, v in w.items()})
    print(agreement(texts[SAMPLE:], family))


def agreement(texts: list[str], family: set[str]) -> dict[str, tuple[int, int, int]]:
    """By type: values of the labeller, values found, and those that are the same."""
    out: dict[str, list[int]] = {t: [0, 0, 0] for t in TYPES}
    for text, spans in zip(texts, pii.find(Model.load(), texts)):
        a, b = set(label(text, family)), set(spans)
        for k, group in enumerate((a, b, a & b)):
            for kind, *_ in group:
                out[kind][k] += 1
        for x in sorted((a ^ b), key=lambda x: x[1])[:3] if SHOW else []:
            print("labeller" if x in a else "model", x[0], repr(text[max(0, x[1] - 20) : x[1]]), repr(text[x[1] : x[2]]), repr(text[x[2] : x[2] + 12]))
    return {k: tuple(v) for k, v in out.items()}


if __name__ == "__main__":
    main(*sys.argv[1:])
