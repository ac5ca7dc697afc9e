"""One consistent form for text that looks the same (problem 2).

Compatibility normalisation in composed form, full case folding, mapped white space and removal of
default-ignorable characters, computed once per distinct value of a batch; letters and signs of other scripts that
cannot be told apart by eye are mapped to one prototype.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Default-ignorable code points of the Unicode Character Database (ranges, inclusive).
IGNORABLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
# Letters and signs that look like another; prototype, then its look-alikes.
LOOKALIKE = """
A А Α Ꭺ
B В Β Ᏼ
C С Ϲ Ꮯ
D Ꭰ
E Е Ε Ꭼ
G Ԍ Ꮐ
H Н Η Ꮋ
I І Ι Ӏ
J Ј Ꭻ
K К Κ K Ꮶ
L Ꮮ
M М Μ Ϻ Ꮇ
N Ν
O О Ο Օ
P Р Ρ Ꮲ
Q Ԛ
S Ѕ Տ Ꮪ
T Т Τ Ꭲ
U Ս
V Ѵ Ꮩ
W Ԝ Ꮃ
X Х Χ
Y Ү Υ
Z Ζ Ꮓ
a а ɑ α
c с ϲ
d ԁ
e е
g ɡ
h һ
i і ι
j ј ϳ
k κ
l ӏ
n ո
o о ο օ
p р ρ
q ԛ
s ѕ
u ս υ
v ѵ ν
w ԝ
x х
y у ү
- ‐ ‑ ‒ – − ˗ ⁃ ﹣ － ֊
' ʹ ʼ ′ ‘ ’ ＇
; ;
! ǃ
: ∶ ː ։
/ ∕ ⁄
| ∣ ǀ ｜
口 ロ
一 ー — ― ─
力 カ
夕 タ
二 ニ
卜 ト
八 ハ
工 エ
へ ヘ
べ ベ
ぺ ペ
千 チ
才 オ
三 ミ
"""
_DROP = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in IGNORABLE) + "]+")
_MAP = {ord(c): row.split(" ")[0] for row in LOOKALIKE.strip().split("\n") for c in row.split(" ")[1:] if c}
_BLANK = re.compile(r"[\s⠀ ]+")
#: Compatibility characters that a reader does tell from their normal form (superscripts, circled, squared, fractions).
_VISIBLE_TAGS = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>", "<font>", "<vertical>")


def one_form(text: str, fold: bool = True) -> str:
    """The consistent form of one text; fold=False keeps letter case, for checks of what a reader sees."""
    if text.isascii():
        text = " ".join(text.split())
        return text.casefold() if fold else text
    text = _DROP.sub("", text)
    text = unicodedata.normalize("NFKC", text)
    text = _DROP.sub("", text).translate(_MAP)
    if fold:
        text = unicodedata.normalize("NFKC", text.casefold()).translate(_MAP)
    return _BLANK.sub(" ", text).strip(" ")


def seen_form(text: str) -> str:
    """What a reader sees: as one_form without folding, but visibly different compatibility characters stay apart."""
    if text.isascii():
        return " ".join(text.split())
    out = "".join(f"\ue000{c}" if unicodedata.decomposition(c).startswith(_VISIBLE_TAGS) else c for c in _DROP.sub("", text))
    return one_form(out, fold=False)


def _per_distinct(values: pd.Series, f) -> pd.Series:
    codes, uniques = pd.factorize(values)
    forms = [f(u) for u in uniques]
    return pd.Series([None if k < 0 else forms[k] for k in codes], dtype="object")


@F.pandas_udf(T.StringType())
def _form_udf(values: pd.Series) -> pd.Series:
    return _per_distinct(values, one_form)


@F.pandas_udf(T.StringType())
def _seen_udf(values: pd.Series) -> pd.Series:
    return _per_distinct(values, seen_form)


def consistent_form(column: Column) -> Column:
    """Column expression of the folded form. Plain ASCII stays in the JVM; only the rest crosses to Python. Null stays null."""
    ascii_only = column.rlike(r"^[\x00-\x7f]*$")
    plain = F.lower(F.trim(F.regexp_replace(column, r"[\s\x1c-\x1f]+", " ")))
    return F.coalesce(F.when(ascii_only, plain), _form_udf(F.when(~ascii_only, column)))


def seen_alike(column: Column) -> Column:
    """Column expression of the form a reader sees (letter case kept). Null stays null."""
    ascii_only = column.rlike(r"^[\x00-\x7f]*$")
    plain = F.trim(F.regexp_replace(column, r"[\s\x1c-\x1f]+", " "))
    return F.coalesce(F.when(ascii_only, plain), _seen_udf(F.when(~ascii_only, column)))


def forms(articles: DataFrame, fields: tuple[str, ...] = ("title", "original_title"), key: str = "article_id") -> DataFrame:
    """One row per article with `<field>_form` of each field. Null gives null, blank gives the empty text."""
    return articles.select(key, *[consistent_form(F.col(f)).alias(f"{f}_form") for f in fields])


def look_alikes(articles: DataFrame, left: str = "title", right: str = "original_title", key: str = "article_id") -> DataFrame:
    """Keys of rows whose two fields are non-empty, look the same to a reader and are not the same string.

    Equality of the consistent forms selects; since that form folds case, the unfolded form then decides. Null or empty
    fields give no row. Rows appear as often as in the input.
    """
    a, b = F.col(left), F.col(right)
    differ = articles.select(key, left, right).where((a != "") & (b != "") & (a != b))
    same = differ.where(consistent_form(a) == consistent_form(b))
    return same.where((seen_alike(a) == seen_alike(b)) & (seen_alike(a) != "")).select(key)
