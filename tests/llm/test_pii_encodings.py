"""Personal data and encodings: parts against direct versions, held-out accuracy, and the defined cases."""

import itertools
from collections import Counter

import numpy as np
import pytest

from scrivan.llm import encodings, pii, pii_train

LETTER = (
    "Em tên là Nguyễn Đức Vân, mã số sinh viên 20013602, hiện cư trú tại\nsố 60A đường Lũng Sương, phường Phú Ngàn, thành phố Hạc Khê.\n"
    "Liên hệ Ksor Thị Mai qua số +84-530-894-646 hoặc thư điện tử mai-ksor+hs@hop-thu . example. Khoa vật lý bàn giao 37.523.000 đồng "
    "trong học kỳ II năm 2024-2025 theo Thông báo số 2632/TB-ĐHSL của Trường Đại học Sương Lâm. Mã giao dịch: 76658777629070\n"
)
VALUES = {
    ("person_name", "Nguyễn Đức Vân"), ("id_number", "20013602"), ("address", "số 60A đường Lũng Sương, phường Phú Ngàn, thành phố Hạc Khê"),
    ("person_name", "Ksor Thị Mai"), ("phone", "+84-530-894-646"), ("email", "mai-ksor+hs@hop-thu . example"),
}


def test_values_and_placeholders(spark):
    rows = [("1", LETTER, None), ("2", "", LETTER.replace("đường Lũng Sương", "đường\nLũng Sương")), ("3", None, None), ("4", "Khoa ngữ văn họp.", "x" * 50_000), ("1", LETTER, None)]
    rows += [("5", LETTER * 40, None)]
    df = spark.createDataFrame([(*r, "q") for r in rows], "id string, raw_text string, corrected_text string, text string")
    got = {}
    for r in pii.found(df).collect():
        got.setdefault((r.ocr_id, r.field_name), []).append((r.pii_type, r.pii_value))
    assert set(got) == {("1", "raw_text"), ("2", "corrected_text"), ("5", "raw_text")}
    assert all(set(v) == VALUES and len(v) == len(VALUES) for v in got.values())
    text = {(r.ocr_id, r.field_name): r.text for r in pii.masked(df).collect()}
    assert text["1", "raw_text"].startswith("Em tên là <PERSON_NAME>, mã số sinh viên <ID_NUMBER>, hiện cư trú tại\n<ADDRESS>.")
    assert "37.523.000 đồng" in text["1", "raw_text"] and text["4", "corrected_text"] == "x" * 50_000
    assert pii.found(df.limit(0)).count() == 0


def test_forms_that_no_pattern_of_the_labeller_has():
    cases = {
        "Liên hệ qua thư x@truong.info hoặc an@khoa.io để biết thêm.": {("email", "x@truong.info"), ("email", "an@khoa.io")},
        "Em cư trú tại 12 Nguyễn Trãi, Đà Lạt, Lâm Đồng từ năm 2020.": {("address", "12 Nguyễn Trãi, Đà Lạt, Lâm Đồng")},
        "Địa chỉ: Số 5, ngách 3/2, đường Lê Lợi, Phường 4, Thành phố Đà Lạt.": {("address", "Số 5, ngách 3/2, đường Lê Lợi, Phường 4, Thành phố Đà Lạt")},
        "Call +44 20 7946 0958 for details.": {("phone", "+44 20 7946 0958")},
        "Em tên là Tôn Nữ Hoàng Thị Ngọc Lan, sinh viên.": {("person_name", "Tôn Nữ Hoàng Thị Ngọc Lan")},
        "We met in Baker Street near the station.": set(),
        "Mã giao dịch: 76658777629070, số tiền 1.250.000 đồng, năm học 2024-2025.": set(),
    }
    got = pii.find(pii.Model.load(), list(cases))
    assert [{(k, t[a:b]) for k, a, b in spans} for t, spans in zip(cases, got)] == list(cases.values())


def test_the_model_reads_what_no_pattern_proposes():
    words = "sinh viên nộp hồ sơ tại phòng công tác theo quy định của nhà trường " * 8
    seen = []
    model = pii.Model.load()
    scores = model.scores
    model.scores = lambda ids: seen.append(ids) or scores(ids)
    number = "mã số sinh viên 2001360"
    assert not pii.stretches(words + number) and pii.find(model, [words, "", number]) == [[], [], [("id_number", 16, 23)]]
    assert sum(int((x > 0).sum()) for x in seen) >= len(words)


def test_made_values_keep_their_labels():
    rng = np.random.default_rng(5)
    maker = pii_train.Maker(rng, {})
    spans = pii_train.label(LETTER, {"nguyễn", "ksor"})
    text, moved = maker.changed(LETTER, spans, 1.0)
    assert len(moved) == len(spans) and all(text[a:b].strip() and text[a - 1] != text[a] for _, a, b in moved)


def test_viterbi_and_crf_equal_enumeration():
    rng = np.random.default_rng(3)
    scores, trans = rng.normal(size=(2, 4, 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
    paths = list(itertools.product(range(3), repeat=4))
    for b in range(2):
        value = {p: scores[b, range(4), p].sum() + sum(trans[x, y] for x, y in zip(p, p[1:])) for p in paths}
        assert tuple(pii.viterbi(scores, trans)[b]) == max(value, key=value.get)
    y = np.array([[0, 1, 2, 0], [1, 1, 0, 2]])
    whole = [np.log(sum(np.exp(scores[b, range(4), p].sum() + sum(trans[x, z] for x, z in zip(p, p[1:]))) for p in paths)) for b in range(2)]
    gold = [scores[b, range(4), y[b]].sum() + sum(trans[x, z] for x, z in zip(y[b], y[b][1:])) for b in range(2)]
    loss, grad, pair = pii_train.crf(scores.astype(np.float64), trans.astype(np.float64), y)
    assert loss == pytest.approx(np.mean(np.array(whole) - gold), rel=1e-5)
    step = 1e-5
    for place in [(0, 1, 2), (1, 3, 0)]:
        moved = scores.astype(np.float64).copy()
        moved[place] += step
        assert (pii_train.crf(moved, trans.astype(np.float64), y)[0] - loss) / step == pytest.approx(grad[place], abs=1e-3)
    moved = trans.astype(np.float64).copy()
    moved[1, 2] += step
    assert (pii_train.crf(scores.astype(np.float64), moved, y)[0] - loss) / step == pytest.approx(pair[1, 2], abs=1e-3)


def test_windows_agree_with_one_pass():
    model = pii.Model.load()
    text = (LETTER * 3)[:600]
    got = pii.label_stretches(model, [text, "ngắn", text[:150]])
    whole = pii.viterbi(model.scores(pii.encode(text)[None]), model.w["trans"])[0]
    assert len(got[0]) == 600 and (got[0] == whole).mean() > 0.97 and len(got[1]) == 4


def test_only_places_in_doubt_are_decoded_and_labels_are_those_of_the_whole(monkeypatch):
    best, decoded = pii._best, []
    monkeypatch.setattr(pii, "_best", lambda scores, lengths, *rest: decoded.append(int(lengths.sum())) or best(scores, lengths, *rest))
    model = pii.Model.load()
    texts = ["", LETTER[:70], "Khoa ngữ văn họp.", LETTER, LETTER[200:430] + LETTER[:20], "Ban thanh tra phân loại lý lịch bản gốc trước khi nộp hồ sơ. " * 8]
    got = pii.label_stretches(model, texts)
    assert 0 < sum(decoded) < 0.7 * sum(map(len, texts))
    whole = lambda t: pii.viterbi(model.scores(pii.encode(t)[None]), model.w["trans"])[0].tolist() if t else []
    assert [x.tolist() for x in got] == [whole(t[: pii.WIDTH]) for t in texts]
    rng = np.random.default_rng(4)
    for scale in (0.5, 2, 5):  # any weights, also such as leave most places in doubt, or open and close values at a text's ends
        model = pii.Model({k: rng.normal(size=v.shape) * (scale if k == "trans" else 1) for k, v in model.w.items()})
        monkeypatch.setattr(pii, "HELD", 150)
        parts = [LETTER[a : a + n] for a, n in zip(rng.integers(0, 300, 40), rng.integers(0, 90, 40))]
        assert [x.tolist() for x in pii.label_stretches(model, parts)] == [whole(t) for t in parts]


def test_labels_hang_neither_on_the_batch_nor_on_the_operators(monkeypatch):
    model = pii.Model.load()
    texts = [LETTER * 4, "", LETTER[:70], (LETTER * 2)[:600], "Khoa ngữ văn họp.", LETTER]
    got = [x.tolist() for x in pii.label_stretches(model, texts)]
    assert [pii.label_stretches(model, [t])[0].tolist() for t in texts] == got
    ids = np.stack([pii.encode(LETTER[k : k + 60]) for k in range(40)])
    scores = model.scores(ids)
    assert all((model.scores(ids[k : k + 1]) == scores[k]).all() for k in range(40))  # to the bit
    monkeypatch.setattr(pii, "WIDTH", 128)
    monkeypatch.setattr(pii, "STEP", 96)
    monkeypatch.setattr(pii, "BLOCK", 100)
    cut = pii.label_stretches(model, texts)
    assert [len(x) for x in cut] == [len(t) for t in texts] and all((a == np.array(b)).mean() > 0.97 for a, b in zip(cut, got) if b)
    monkeypatch.undo()
    monkeypatch.setattr(pii, "_session", lambda *_: None)  # numpy alone
    assert [x.tolist() for x in pii.label_stretches(model, texts)] == got and abs(model.scores(ids) - scores).max() < 1e-3


def test_training_lowers_loss():
    rng = np.random.default_rng(1)
    texts = [LETTER.replace("Đức Vân", n).replace("20013602", str(20000000 + k)) for k, n in enumerate(["Văn An", "Thị Bích", "Kim Sơn", "Hữu Hạnh"] * 6)]
    xs, ys = pii_train.windows(texts, {"nguyễn", "ksor"}, rng)
    said = []
    w = pii_train.train(xs, ys, hidden=8, width=8, steps=300, batch=24, say=lambda step, loss: said.append(loss))
    assert said[-1] < said[0] and set(pii_train.accuracy(w, xs, ys)) == set(pii.TYPES)


WORDS = ["trường", "đại", "học", "phòng", "công", "tác", "viện", "của", "được", "số", "năm", "hồ", "sơ", "đảo", "trước", "ngày", "café", "séance", "élève", "tài", "hè"]


def documents():
    rows = [(k, " ".join(WORDS[(k + j) % len(WORDS)] for j in range(40)), "nguồn") for k in range(60)]
    clean = "Phòng công tác của trường đại học được"
    tcvn = {c: chr(b) for b, c in encodings._tcvn3.items()}
    for k, page in enumerate(["cp1252", "latin-1", "cp437", "mac_roman"]):
        rows.append((100 + k, clean.encode().decode(page, errors="replace" if page == "cp1252" else "strict"), "s"))
        rows.append((110 + k, "hồ sơ " + "viện".encode().decode(page, errors="ignore") + " năm", None))
    twice = clean.encode().decode("latin-1").encode().decode("latin-1")
    rows += [(120, twice, "s"), (121, "".join(tcvn.get(c, c) for c in clean.lower()), "t"), (122, "hồ s�", "t")]
    import unicodedata

    rows += [(200, unicodedata.normalize("NFD", clean), "s"), (201, "", "s"), (202, None, "s"), (203, "“café” – £40…", "s"), (204, "TRƯỜNG ĐẠI HỌC", None), (205, "số " * 60_000, "s"), rows[0]]
    return rows, clean


def test_garbled_documents(spark, monkeypatch):
    monkeypatch.setattr(encodings, "LEAST", 3)
    rows, clean = documents()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, garbled int")
    got = {r.doc_id: r.text for r in encodings.texts(df).collect()}
    assert set(got) == {100, 101, 102, 103, 110, 111, 112, 113, 120, 121, 122}
    for k in (101, 102, 103, 120):
        assert got[k] == clean
    assert got[121] == clean.lower()
    assert {r.doc_id for r in encodings.found(df).collect()} == set(got)
    assert encodings.found(df.limit(0)).count() == 0
    assert set(encodings.ciphers(df).columns) == {"source", "symbol", "letter", "p", "n"}


def test_em_learns_a_cipher():
    import pandas as pd

    words = pd.DataFrame({"token": WORDS, "n": [1000] * len(WORDS)})
    language = encodings.Language(words)
    cipher = {c: chr(0x4E00 + k) for k, c in enumerate(sorted({c for w in WORDS for c in w if not c.isascii()}))}
    seen = ["".join(cipher.get(c, c) for c in w) for w in WORDS if not w.isascii()]
    rows = [(*x, 50) for w in seen for x in encodings.surroundings(w)]
    out = encodings.expectation_maximization(pd.DataFrame(rows, columns=["before", "run", "after", "n"]), language)
    best = out.sort_values("p").groupby("symbol").letter.last()
    assert sum(best[s] == c for c, s in cipher.items()) >= 0.9 * len(cipher)
    assert encodings.apart("được") == "đươ\u0323c" and encodings.multibyte("sá»‘") and not encodings.multibyte("häc")


def test_the_cipher_reads_words_without_any_page_table(spark, monkeypatch):
    monkeypatch.setattr(encodings, "LEAST", 3)
    rows, clean = documents()
    cipher = {c: chr(0x1200 + k) for k, c in enumerate(sorted({c for w in WORDS for c in w if not c.isascii()}))}
    texts = [" ".join(WORDS[(5 * k + 3 * j) % 16] for j in range(12)) for k in range(12)]
    rows += [(300 + k, "".join(cipher.get(c, c) for c in t), "u") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r.text for r in encodings.restored(df, pages=False).collect()}
    pairs = [(a, b) for k, t in enumerate(texts) for a, b in zip(t.split(), got[300 + k].split())]
    assert sum(a == b for a, b in pairs) >= 0.9 * len(pairs)
    assert not {300 + k for k in range(12)} & {r.doc_id for r in encodings.restored(df, pages=False, ciphered=False).collect()}


def test_pages_are_tried_only_where_they_can_read_utf8_and_none_is_missed(monkeypatch):
    def shown(word, page):
        try:
            return word.encode().decode(page)
        except UnicodeDecodeError:
            return word

    def readings(word, deep=3):
        for page in encodings.SHOWN:
            raw = [ord(c) if c.isascii() else encodings._PAGES[page].get(ord(c)) for c in word]
            try:
                read = None if None in raw else bytes(raw).decode()
            except UnicodeDecodeError:
                continue
            if read not in (None, word):
                yield from readings(read, deep - 1) if deep > 1 and not read.isascii() else ()
                yield read

    rng = np.random.default_rng(7)
    words = {"".join(rng.choice(list("aĐđếâ€™Ãº»‘\x81\x9d\xa0ÄЂ÷ÿ¿Ā€\ufffd😀ệ-Æ°"), rng.integers(1, 6))) for _ in range(3000)}
    words |= {shown(shown(w, a), b) for w in WORDS for a in encodings.SHOWN for b in ("cp1252", "latin-1", "cp437")} | {""}
    direct = {w: list(readings(w)) for w in words}
    assert {w: list(encodings.utf8_readings(w)) for w in words} == direct and sum(map(bool, direct.values())) > 300
    tried, back = [], encodings._back
    monkeypatch.setattr(encodings, "_back", lambda word, page: tried.append(word) or back(word, page))
    assert not any(list(encodings.utf8_readings(w)) for w in ("của", "hồ", "2574/BM-ĐHSL", "Đ")) and not tried
    reader = encodings.Reader({"hồ": 5000, "năm": 5000}, {})
    asked, word = [], reader.word
    reader.word = lambda w, source: asked.append(w) or word(w, source)
    assert [reader.text("hồ năm sá»‘", s)[1] for s in "sst"] == [True] * 3
    assert Counter(asked) == {"hồ": 2, "năm": 2, "sá»‘": 3}  # words that are no case once a source


@pytest.mark.parametrize("times", [1, 10, 100])
def test_reading_does_not_depend_on_the_size_of_the_collection(times):
    counts = {"số": 5000, "sá": 235, "sè": 114, "hồ": 4000, "há": 102, "cố": 900, "cá": 1970, "kỳ": 2000, "kú": 84, "năm": 6000}
    reader = encodings.Reader({w: n * times for w, n in counts.items()}, {})
    assert reader.text("sá»‘ há»“ Cá»‘ năm", "s") == ("số hồ Cố năm", True)
    assert reader.text("sè kú năm", "s") == ("số kỳ năm", True)
    assert reader.text("số hồ cố kỳ năm cá", "s") == ("số hồ cố kỳ năm cá", False)
    assert "sè" not in reader.known and "cá" in reader.known
