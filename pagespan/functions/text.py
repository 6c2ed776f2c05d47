"""Text functions on columns. White space and line ends are Unicode's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "[\\s\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\u001C-\\u001F]"
#: The same characters one by one: ends are trimmed without a pattern, which would try each run of white space from each of its places.
SPACES = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
LINE_END = "\\r\\n|[\\n\\r\\x0B\\x0C\\u001C-\\u001E\\u0085\\u2028\\u2029]"
# Labels of choices and marks of lists.
CHOICE = "^(\\(?\\d{1,2}[\\).]|[①-⑳]|[A-Z][\\).]|[가-하]\\.|[가-하]\\))\\s*(.+)$"
BULLET = "^([\\-•]|\\d+\\.)\\s*(.+)$"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def lines(text: Column) -> Column:
    """Lines without their ends; an end at the end begins no further line."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, f"(?:{LINE_END})\\z", ""), LINE_END))


def filled_lines(text: Column) -> Column:
    return F.filter(F.transform(lines(text), strip), lambda x: x != "")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def first_line(text: Column) -> Column:
    return first_of(lines(text))


def first_of(all_: Column) -> Column:
    return F.coalesce(F.get(all_, F.lit(0)), F.lit(""))


def remainder(text: Column) -> Column:
    """What follows the first line, stripped."""
    return rest_of(lines(text))


def rest_of(all_: Column) -> Column:
    return F.when(F.size(all_) > 1, strip(F.array_join(F.slice(all_, F.lit(2), F.size(all_)), "\n"))).otherwise(F.lit(""))


def normalize_choices(text: Column) -> Column:
    one = lambda x: F.when(x.rlike(CHOICE), F.concat(F.regexp_extract(x, CHOICE, 1), F.lit(" "), strip(F.regexp_extract(x, CHOICE, 2)))).otherwise(F.concat(F.lit("• "), x))
    return F.array_join(F.transform(filled_lines(text), one), "\n")


def _marked(text: Column, mark: str) -> Column:
    one = lambda x: F.concat(F.lit(mark), F.when(x.rlike(BULLET), strip(F.regexp_extract(x, BULLET, 2))).otherwise(x))
    return F.array_join(F.transform(filled_lines(text), one), "\n")


def normalize_list(text: Column) -> Column:
    return _marked(text, "- ")


def normalize_reading_list(text: Column) -> Column:
    return _marked(text, "• ")


def merge_visual(text: Column, ai: Column) -> Column:
    """The description and then the recognised text; whichever exists."""
    ai, text = F.coalesce(ai, F.lit("")), F.coalesce(text, F.lit(""))
    return F.when((ai != "") & (text != ""), F.concat_ws("\n", ai, text)).when(ai != "", ai).otherwise(text)


@F.pandas_udf(T.StringType())
def nfkc(texts):
    """Compatibility composition; Spark has no function for it."""
    return texts.str.normalize("NFKC")


def normalize_question_type(text: Column) -> Column:
    return F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), "\\r\\n|\\r|\\n", " ")


def apply_rule(text: Column, prefix: Column, suffix: Column, indent: Column, allow_empty: Column, keep_suffix: Column | None = None) -> Column:
    """Prefix, an indent to each filled line, suffix; empty content gives nothing, or the prefix alone."""
    keep_suffix = F.lit(False) if keep_suffix is None else keep_suffix
    pad = F.repeat(F.lit(" "), indent)
    indented = F.array_join(F.transform(lines(text), lambda x: F.when(strip(x) == "", F.lit("")).otherwise(F.concat(pad, x))), "\n")
    ruled = lambda body: F.when((body == "") & ~keep_suffix, prefix).otherwise(F.concat(prefix, body, suffix))
    return F.when((text == "") & ~allow_empty, F.lit("")).otherwise(let(F.when(indent > 0, indented).otherwise(text), ruled))


def limit_blank_runs(text: Column, most: int = 2) -> Column:
    """At most ``most`` blank lines in a row, lines cut at their right, the whole stripped."""
    clean = F.array_join(F.transform(lines(text), rstrip), "\n")
    return strip(F.regexp_replace(clean, f"\\n{{{most + 1}}}\\n+", "\n" * (most + 1)))


def preview(text: Column, n: int) -> Column:
    """One line of at most n characters, and dots where more follows."""
    flat = F.regexp_replace(text, "\n", " ")
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("..."))).otherwise(flat)


def confidence_label(confidence: Column) -> Column:
    """Whole per cent, halves up."""
    return F.concat(F.floor(confidence * 100 + 0.5).cast("string"), F.lit("%"))


def duration_label(seconds: Column) -> Column:
    """Milliseconds below a second, else seconds with two digits; a dash where unknown."""
    short = F.concat(F.format_string("%.0f", seconds * 1000), F.lit("ms"))
    return F.when(seconds.isNull(), "-").when(seconds < 1, short).otherwise(F.concat(F.format_string("%.2f", seconds), F.lit("초")))


def normalise_path(path: Column) -> Column:
    return F.regexp_replace(path, "\\\\", "/")


def safe_filename(name: Column) -> Column:
    """Letters and digits of any script, dots, underscores and hyphens; 50 characters at most."""
    return F.substring(F.regexp_replace(name, "[^\\p{L}\\p{N}._-]", ""), 1, 50)


@F.pandas_udf(T.StringType())
def _wrapped(texts, widths):
    import re
    import textwrap

    def one(text, width):
        if text is None or len(text.strip()) <= 1:
            return ""
        keep = re.compile(r"(\d+\.\s|[-*]\s)")  # fixed value: how lines of a list begin
        return "\n".join(x if keep.match(x) else textwrap.fill(x, width=int(width)) for x in map(str.strip, text.split("\n")))

    return texts.combine(widths, one)


def wrap_text(text: Column, width: int = 25) -> Column:
    """Lines that begin like a list stay, others are filled to ``width`` (breaking after hyphens and within longer words).

    Python's own filling rules have no counterpart among Spark's functions, so that it runs as an Arrow function.
    """
    return _wrapped(text, F.lit(width))


# Labels that a choice begins with.
CHOICE_LABELS = ["^([①②③④⑤⑥⑦⑧⑨⑩])", f"^[(（]{SPACE}*([1-5]){SPACE}*[)）]", f"^([1-5]){SPACE}*[.．]"]
# Words of passages and of explanations.
PASSAGE_WORDS = ["다음을", "아래의", "위의", "그림을", "표를"]
EXPLANATION_WORDS = ["설명", "해설", "풀이", "답:"]


def choice_number(text: Column) -> Column:
    """The digit of the label that a choice begins with; empty where there is none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in CHOICE_LABELS], F.lit(""))


def classify_text(text: Column) -> Column:
    """choices, passage, explanations or question_text, by pattern and keyword."""
    return F.when(text.rlike("|".join(CHOICE_LABELS)), "choices").when(text.rlike("|".join(PASSAGE_WORDS)), "passage").when(text.rlike("|".join(EXPLANATION_WORDS)), "explanations").otherwise("question_text")


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""))


def section_header(page_number: Column, version: Column, kind: Column) -> Column:
    """A page's line in a project's text; a page without a version says so."""
    state = F.when(version.isNull(), "내용 없음").otherwise(F.concat(F.lit("Version: "), version.cast("string"), F.lit(" - "), F.coalesce(kind, F.lit("None"))))
    return F.concat(F.lit("─── 페이지 "), page_number.cast("string"), F.lit(" ("), state, F.lit(") ───"))


def date_label(ts: Column, form: str = "file") -> Column:
    return F.date_format(ts, {"file": "yyyyMMdd_HHmmss", "iso": "yyyy-MM-dd'T'HH:mm:ss", "minute": "yyyy-MM-dd HH:mm"}[form])


def numeric_map_only(values: Column) -> Column:
    return F.map_filter(values, lambda k, v: v.isNotNull() & ~F.isnan(v))
