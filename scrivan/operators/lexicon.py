"""Word tables of search and classification, and the rewriting of queries with them on the driver.

All tables here are fixed values: results must equal those of the collections' present search, whose words these are.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

# Abbreviations and slang with what they stand for.
ACRONYMS = {
    "nha a11": "Nhà A11 Phòng CTSV", "phong ctsv": "Phòng Công tác Sinh viên", "p ctsv": "Phòng Công tác Sinh viên", "a11": "Nhà A11",
    "mghp": "miễn giảm học phí", "mg hp": "miễn giảm học phí", "hb kkht": "học bổng khuyến khích học tập", "kkht": "học bổng khuyến khích học tập",
    "hbdn": "học bổng tài trợ doanh nghiệp", "hb dn": "học bổng tài trợ doanh nghiệp", "hb": "học bổng", "htcpht": "hỗ trợ chi phí học tập", "htcp": "hỗ trợ chi phí học tập",
    "drl": "điểm rèn luyện", "dtrl": "điểm rèn luyện", "shcd": "sinh hoạt công dân sinh viên", "shcdsv": "sinh hoạt công dân sinh viên",
    "cpa": "điểm tích lũy CPA", "gpa": "điểm trung bình học kỳ GPA", "cdr": "chuẩn đầu ra tốt nghiệp", "ctdt": "chương trình đào tạo", "ctđt": "chương trình đào tạo",
    "cvht": "cố vấn học tập", "blht": "bảo lưu kết quả học tập", "gdtc": "giáo dục thể chất thể dục", "gdqp-an": "giáo dục quốc phòng an ninh", "gdqp": "giáo dục quốc phòng an ninh",
    "tam hoan nvqs": "tạm hoãn nghĩa vụ quân sự", "hoan nvqs": "tạm hoãn nghĩa vụ quân sự", "nvqs": "nghĩa vụ quân sự", "bhyt": "bảo hiểm y tế", "ktx": "ký túc xá",
    "ctsv": "Công tác Sinh viên", "the sv": "thẻ sinh viên", "tsv": "thẻ sinh viên", "nhcsxh": "Ngân hàng Chính sách Xã hội", "csxh": "Chính sách xã hội",
    "stk": "số tài khoản đóng học phí", "hp": "học phí",
}
# Words of a query, and what is searched beside them.
EXPANSIONS = {
    "mghp": ["mien giam hoc phi", "mghp", "nghi dinh 81", "81/2021"], "kkht": ["hoc bong khuyen khich", "kkht", "khuyen khich hoc tap", "quyet dinh 688", "688"],
    "drl": ["diem ren luyen", "drl", "ren luyen", "88/hd", "huong dan 88"], "cpa": ["gpa", "cpa", "diem tich luy", "canh bao hoc vu", "hoc luc"], "gpa": ["gpa", "cpa", "diem tich luy"],
    "nvqs": ["nghia vu quan su", "nvqs", "tam hoan nvqs", "13/2013/ttlt", "di linh", "quan su"], "bhyt": ["bao hiem y te", "bhyt", "bao hiem than the", "55/tb", "thong bao 55"],
    "bhxh": ["bao hiem xa hoi", "bhxh"], "mssv": ["ma so sinh vien", "mssv"], "gvcn": ["giang vien chu nhiem", "gvcn"], "ctsv": ["cong tac sinh vien", "ctsv"],
    "ktx": ["ky tuc xa", "ktx", "noi tru", "cho o gia re", "315/qd"], "blht": ["bao luu", "tam dung", "nghi hoc tam thoi", "blht", "nghi hoc co thoi han"],
    "htcpht": ["ho tro chi phi hoc tap", "htcpht", "chi phi hoc tap"], "ctxh": ["cong tac xa hoi", "ctxh"], "nckh": ["nghien cuu khoa hoc", "nckh", "890/qd"],
}
# Notions inside a query, and what is searched beside them.
NOTIONS = {
    "tam dung": ["tam hoan", "bao luu", "nghi hoc co thoi han", "nghi hoc tam thoi"], "bao luu": ["tam hoan", "tam dung", "nghi hoc co thoi han"], "nghi hoc": ["tam dung", "bao luu", "nghi hoc co thoi han"],
    "ky tuc xa": ["ktx", "cho o gia re", "noi tru"], "ho tro chi phi": ["ho tro chi phi hoc tap", "htcpht"], "hoc bong khuyen khich": ["kkht", "hoc bong k1", "hoc bong ky 1"],
    "vay von": ["ngan hang chinh sach", "giay xac nhan", "205/hd"], "nghia vu quan su": ["nvqs", "hoan di linh", "tam hoan nvqs"], "mien giam hoc phi": ["mghp", "nghi dinh 81"], "diem ren luyen": ["drl", "ren luyen", "88/hd"],
}
# Fields of work: (name, what in a query tells it, what a document of it holds); the first that fits counts.
DOMAINS = [
    ("NVQS", ["nvqs", "nghia vu quan su", "di linh", "hoan nvqs", "quan su"], ["nghia vu quan su", "nvqs", "tam hoan nvqs", "13/2013", "di linh", "quan su", "ban chi huy quan su"]),
    ("MGHP", ["mghp", "mien giam hoc phi", "81/2021", "nghi dinh 81", "xin mghp"], ["mien giam hoc phi", "mghp", "nghi dinh 81", "81/2021", "giam hoc phi", "mien hoc phi", "chinh sach mien giam", "chinh sach hoc phi"]),
    ("KKHT", ["kkht", "hoc bong khuyen khich", "688", "quyet dinh 688", "xet kkht"], ["hoc bong khuyen khich", "kkht", "khuyen khich hoc tap", "quyet dinh 688", "688/qd", "hoc bong k1", "1413/tb"]),
    ("DRL", ["drl", "diem ren luyen", "88/hd", "huong dan 88", "cham drl", "ren luyen"], ["diem ren luyen", "drl", "ren luyen", "88/hd", "huong dan 88"]),
    ("KTX", ["ktx", "ky tuc xa", "noi tru", "o ktx"], ["ky tuc xa", "ktx", "noi tru", "cho o", "315/qd"]),
    ("BHYT", ["bhyt", "bao hiem y te", "55/tb", "mua bhyt"], ["bao hiem y te", "bhyt", "bao hiem than the", "55/tb", "thong bao 55"]),
    ("BLHT", ["blht", "tam dung", "bao luu", "nghi hoc", "xin blht"], ["bao luu", "tam dung", "nghi hoc co thoi han", "nghi hoc tam thoi", "blht", "tam hoan va bao luu"]),
    ("HTCPHT", ["htcpht", "ho tro chi phi hoc tap", "ho tro chi phi"], ["ho tro chi phi hoc tap", "htcpht", "chi phi hoc tap"]),
    ("VAY_VON", ["vay von", "ngan hang chinh sach", "205/hd"], ["vay von", "ngan hang chinh sach", "205/hd", "giay xac nhan"]),
    ("CPA", ["cpa", "gpa", "tich luy", "canh bao hoc vu"], ["gpa", "cpa", "diem tich luy", "canh bao hoc vu", "hoc luc"]),
    ("NCKH", ["nckh", "nghien cuu khoa hoc", "890/qd", "890"], ["nghien cuu khoa hoc", "nckh", "890/qd", "890"]),
]
# Words of document forms, and words that tell no topic.
FORMS = set("don xin de nghi phieu giay to ban so thong bao quyet dinh cao ke hoach huong dan danh sach quy che bien".split())
FILLERS = set("va cua cho ve cac tai theo duoc co trong da la sinh vien bo phong to chuc truong dai hoc nam thang ngay can nhung gi o dau nhu the nao khi bi khong gap nhanh hoi xem biet em voi giup tap".split())
INSTITUTIONAL = ("Thông tư", "Quyết định", "Quy định", "Quy chế", "Hướng dẫn", "Thông báo", "Báo cáo")
# Misreadings that a query typed off a scan may have.
MISREAD = [(r"\bl(\d)", r"1\1"), (r"\b202O\b", "2020"), (r"(\d)[oO]\b", r"\g<1>0")]
# Words that mean the same.
SYNONYMS = ["hoc bong,scholarship,hb", "hoc phi,tuition", "ky tuc xa,dormitory,ktx", "kinh phi,budget", "thu vien,library", "tap huan,training", "quyet dinh,decision,qd", "thong bao,notice,tb"]


def folded(text: str) -> str:
    """Lower case without accents, đ as d, blanks at the ends cut."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower().replace("đ", "d")) if not unicodedata.combining(c)).strip()


_ACRONYM = re.compile(r"\b(" + "|".join(re.escape(k) for k in sorted(ACRONYMS, key=len, reverse=True)) + r")\b", re.IGNORECASE)


def resolved(text: str) -> tuple[str, bool]:
    """Abbreviations written out in one pass, longer ones first, and whether there were any."""
    out, n = _ACRONYM.subn(lambda m: ACRONYMS[m.group().lower()], text)
    return out, n > 0


def corrected(text: str) -> str:
    """A query with its usual misreadings mended, then written out."""
    for pattern, to in MISREAD:
        text = re.sub(pattern, to, text)
    return resolved(text)[0]


def domain_of(q: str) -> str | None:
    return next((name for name, told, _ in DOMAINS if any(x in q for x in told)), None)


@dataclass
class Spec:
    """One query, rewritten: everything about it that documents are measured against."""

    q: str
    terms: list[str] = field(default_factory=list)
    syns: list[str] = field(default_factory=list)
    pairs: list[str] = field(default_factory=list)
    topics: list[str] = field(default_factory=list)
    forms: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    full: str = ""
    plain: bool = True

    @classmethod
    def of(cls, text: str) -> Spec:
        q, full = folded(text), folded(resolved(text)[0])
        words = q.split()
        syns = [s for w in words for s in EXPANSIONS.get(w, [])] + EXPANSIONS.get(q, []) + [s for k, v in NOTIONS.items() if k in q for s in v]
        name = domain_of(q) or domain_of(full)
        idle = FILLERS | FORMS
        return cls(
            q, next((t for n, _, t in DOMAINS if n == name), []), sorted(set(syns)),
            [f"{a} {b}" for a, b in zip(words, words[1:]) if not (a in idle and b in idle)], [w for w in words if w not in idle], [w for w in words if w in FORMS],
            sorted(set(words + full.split())), full, not q.startswith("don xin"),
        )
