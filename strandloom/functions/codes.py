"""Column functions over medical code strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code shapes.
ICD9 = r"^(V\d{2}(\.\d{1,2})?|\d{3}(\.\d{1,2})?|E\d{3}(\.\d)?)$"
ICD9_BASE = r"^(V\d{2}|\d{3}|E\d{3})$"
ICD10 = r"(?i)^[A-TV-Z][0-9][A-Z0-9](\.\w{1,4}\b)?"
MED = r"^(MULTUM|NDC|MED):\d{2,12}"
ROOT = r"(?i)^([ve]?)(\d+)"


def root_code(c: Column) -> Column:
    """Optional letter and digits before the dot; anything else unchanged."""
    found = F.regexp_extract(c, r"(?i)^([ve]?\d+)", 1)
    return F.when(found != "", found).otherwise(c)


def text_root(c: Column) -> Column:
    """Trimmed text before the first dot."""
    return F.trim(F.substring_index(c, ".", 1))


def is_icd9(c: Column) -> Column:
    return c.rlike(ICD9)


def is_icd9_base(c: Column) -> Column:
    return ~c.contains(".") & c.rlike(ICD9_BASE)


def is_icd10(c: Column) -> Column:
    return c.rlike(ICD10)


def is_icd10_base(c: Column) -> Column:
    return ~c.contains(".") & c.rlike(ICD10)


def is_icd(c: Column) -> Column:
    return is_icd9(c) | is_icd10(c)


def is_med_code(c: Column) -> Column:
    """A prefixed drug code, whatever the prefix's case."""
    return F.upper(c).rlike(MED)


def is_supplementary(c: Column) -> Column:
    return F.lower(c).rlike("^[ev]")


def numerize(c: Column) -> Column:
    """The code as a number; E codes after 5000, V codes after 22000; null if it isn't one."""
    value = F.regexp_replace(c, r"(?i)^[ev]", "").try_cast("double")
    return F.when(F.lower(c).startswith("e"), value + 5000).when(F.lower(c).startswith("v"), value + 22000).otherwise(value)


def within(c: Column, low: str, high: str) -> Column:
    """Between two codes by number, for an equal letter and an equal count of base digits."""
    base = F.regexp_extract(c, ROOT, 2)
    letter, n = low[0].lower() if low[0].lower() in "ev" else "", len(low.lstrip("EeVv").split(".")[0])
    value = F.regexp_replace(c, r"(?i)^[ev]", "").try_cast("double")
    strip = lambda s: float(s.lstrip("EeVv"))
    return F.coalesce((F.lower(F.regexp_extract(c, ROOT, 1)) == letter) & (F.length(base) == n) & value.between(strip(low), strip(high)), F.lit(False))


def is_a(x: Column, y: Column, strict: bool = False) -> Column:
    """x is a y: y is a prefix (strict) or they share the root, and x is not shorter."""
    return (F.length(x) >= F.length(y)) & (x.startswith(y) if strict else text_root(x) == text_root(y))


def dotted(c: Column) -> Column:
    """'25015' to '250.15': a dot after three characters where there is none."""
    return F.when(c.contains(".") | (F.length(c) <= 3), c).otherwise(F.concat(F.substring(c, 1, 3), F.lit("."), c.substr(F.lit(4), F.length(c))))


def repair(c: Column) -> Column:
    """Trimmed, one trailing dot dropped, extra dots dropped, a short number's base filled with zeros, dotted."""
    c = F.regexp_replace(F.trim(c), r"\.$", "")
    head, tail = F.substring_index(c, ".", 1), F.regexp_replace(c, r"^[^.]*\.?", "")
    head = F.when(head.rlike(r"^\d{1,2}$"), F.lpad(head, 3, "0")).otherwise(head)
    tail = F.replace(tail, F.lit("."), F.lit(""))
    return F.when(tail != "", F.concat(head, F.lit("."), tail)).otherwise(dotted(head))


def strip_diagnosis_prefix(c: Column) -> Column:
    return F.regexp_replace(c, "^I(10|9):", "")


def drop_trailing_dot(c: Column) -> Column:
    return F.regexp_replace(c, r"\.$", "")


def condense(c: Column) -> Column:
    """Words without punctuation, capitalised, joined by '_'; nothing left gives 'empty'."""
    words = F.array_remove(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9 ]", " "), " +"), "")
    joined = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), "_")
    return F.when(joined == "", "empty").otherwise(joined)


def words(c: Column) -> Column:
    """Lower-case words of letters, digits and -_:."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[-0-9a-z_:.]+"), 0)


def ndc_normalize(c: Column) -> Column:
    """A drug code as 11 digits (5-4-2), or null.

    '*' reads as 0; two parts get '00' as the third; three are padded or cut on the left; without dashes 11 digits
    stay and 12 with a leading 0 lose it.
    """
    parts = F.split(F.replace(c, F.lit("*"), F.lit("0")), "-")
    part = lambda i: F.coalesce(F.get(parts, i), F.lit("00"))
    last = lambda s, n: F.right(F.concat(F.lit("0" * n), s), F.lit(n))
    joined = F.concat(last(part(0), 5), last(part(1), 4), last(part(2), 2))
    plain = F.get(parts, 0)
    one = F.when((F.length(plain) == 12) & plain.startswith("0"), plain.substr(2, 11)).when(F.length(plain) == 11, plain)
    found = F.when(F.size(parts).isin(2, 3), joined).when(F.size(parts) == 1, one)
    return F.when((F.length(c).between(1, 14)) & found.rlike("^[0-9]+$"), found)


def ndc_candidates(c: Column) -> Column:
    """A ten-digit code cut 4-4-2, 5-3-2 and 5-4-1."""
    cut = lambda *n: F.concat_ws("-", *[c.substr(sum(n[:i]) + 1, x) for i, x in enumerate(n)])
    return F.array(cut(4, 4, 2), cut(5, 3, 2), cut(5, 4, 1))


# Diabetes types as code classes.
def is_type1(c: Column) -> Column:
    return c.rlike(r"^250\.\d[13]$")


def is_type2(c: Column) -> Column:
    return c.rlike(r"^250\.\d[02]$")


def is_gestational(c: Column) -> Column:
    return c.rlike(r"^648\.[08]")


def is_diabetes(c: Column) -> Column:
    return F.substring(c, 1, 3).isin("249", "250", "648")


def base_number(c: Column) -> Column:
    """The number before the dot, E and V codes shifted as in ``numerize``; null if there is none."""
    return numerize(text_root(c))


def same_number(a: Column, b: Column) -> Column:
    """Equal base numbers ('042' and '42' too)."""
    return F.coalesce(base_number(a) == base_number(b), F.lit(False))


def same_root(a: Column, b: Column) -> Column:
    return F.coalesce(text_root(a) == text_root(b), F.lit(False))


def same_text(a: Column, b: Column) -> Column:
    """Equal but for case and outer white space."""
    return F.coalesce(F.lower(F.trim(a)) == F.lower(F.trim(b)), F.lit(False))


def greater(a: Column, b: Column) -> Column:
    """A larger base, told only for bases of as many characters."""
    return F.coalesce((F.length(text_root(a)) == F.length(text_root(b))) & (base_number(a) > base_number(b)), F.lit(False))


def less(a: Column, b: Column) -> Column:
    return greater(b, a)


def matching(target: Column, candidates: Column, base_only: bool = True) -> Column:
    """(position, code) of the candidates that are the target, by root or as a whole."""
    same = (lambda c: text_root(c) == text_root(target)) if base_only else (lambda c: c == target)
    return F.filter(F.transform(candidates, lambda c, i: F.when(same(c), F.struct(i.alias("position"), c.alias("code")))), lambda x: x.isNotNull())


def is_source_value(c: Column) -> Column:
    """A drug code behind a prefix, or digits alone."""
    return is_med_code(c) | c.rlike(r"^\d+$")


def is_description(c: Column, words: int = 2) -> Column:
    """Several words, the first of them of letters and digits."""
    parts = F.split(F.trim(c), r"\s+")
    return (F.size(parts) >= words) & F.forall(F.slice(parts, 1, words), lambda w: w.rlike("^[A-Za-z0-9]+$"))


def after_prefix(c: Column, sep: str = ":") -> Column:
    """The part behind the prefix; a code without one is unchanged."""
    return F.when(c.contains(sep), F.substring_index(c, sep, -1)).otherwise(c)


def class_name(c: Column) -> Column:
    """A drug class name without its bracketed code, in lower case, with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, r"\[[^\]]*\]", " ")), r"\s+", " "))


def all_match(c: Column, patterns: list[str]) -> Column:
    """Whether every pattern is found, whatever the case."""
    out = F.lit(True)
    for p in patterns:
        out = out & c.rlike(f"(?i){p}")
    return out


def token_class(c: Column) -> Column:
    """diag, drug, lab (digits alone) or other."""
    return F.when(is_icd(c), "diag").when(is_med_code(c), "drug").when(c.rlike(r"^\d+$"), "lab").otherwise("other")


def drug_class(c: Column) -> Column:
    """The prefix of a drug code in lower case: med, ndc, multum; others are unknown."""
    return F.when(is_med_code(c), F.lower(F.substring_index(c, ":", 1))).otherwise("unknown")


#: Code books by name: the codes or prefixes of a disease.
CODE_BOOKS = {"ckd": ["585", "584", "403", "404"], "diabetes": ["249", "250", "648"]}


def in_code_book(c: Column, name: str) -> Column:
    """Whether a code is in, or under, a code of the book."""
    out = F.lit(False)
    for root in CODE_BOOKS[name.lower()]:
        out = out | c.startswith(root)
    return out
