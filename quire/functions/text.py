"""Text operators as native expressions: each takes and returns Columns, so Catalyst sees all of them.

A text is one string column. Where neighbours of a line matter, the lines are an array and each line's result depends on
the lines beside it only; where code fences matter, the text is cut into segments once and the operator is applied to
those outside.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import BULLETS, CAPITALS_LINE, CHAPTER_LINE, LANGUAGES, LIGATURES, MONOSPACE, NUMBERED_2_LINE, NUMBERED_3_LINE, PAGE_NUMBER_LINES, RARE_QUOTES, SKIPPED_LINE, SUPERSCRIPTS

Op = Callable[[Column], Column]
#: White space of a line, as a Java class, and what ends lines besides \n.
BLANK = r"[^\S\n]"
MARKER = r"<!-- page \d+ -->"


def let(value: Column, use: Op) -> Column:
    """use(value) with value computed once for the row: lambdas would compute an expression again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lines(text: Column) -> Column:
    """The lines of a text; what follows the last line end isn't a line if it is empty."""
    return let(F.split(text, "\n"), lambda p: F.when(F.get(p, F.size(p) - 1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def at(array: Column, i: Column) -> Column:
    """An element by its number from 0, null outside."""
    return F.when((i >= 0) & (i < F.size(array)), F.get(array, i))


def join(array: Column) -> Column:
    return F.array_join(array, "\n", "")


def normalize_line(line: Column) -> Column:
    """White space at the ends away, inner runs one blank."""
    return F.regexp_replace(F.regexp_replace(line, r"(?U)\A\s+|\s+\z", ""), r"(?U)\s+", " ")


# Fences: (inside, text) segments in order. A line that begins with three backticks or tildes opens a fence, and only
# one of the same character closes it.


def segments(text: Column) -> Column:
    return let(F.split(text, "\n"), lambda rows: let(_cuts(rows), lambda cuts: _pieces(rows, cuts)))


def _cuts(rows: Column) -> Column:
    """Line numbers at which segments begin, and the number of lines."""
    kinds = F.transform(rows, lambda x, i: F.struct(F.regexp_extract(x, r"\A\s*(```|~~~)", 1).alias("kind"), i.alias("i")))
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<int>").alias("cuts"))
    folded = F.aggregate(
        F.filter(kinds, lambda x: x["kind"] != ""),
        start,
        lambda a, x: F.when(a["open"] == "", F.struct(x["kind"].alias("open"), F.concat(a["cuts"], F.array(x["i"])).alias("cuts")))
        .when(a["open"] == x["kind"], F.struct(F.lit("").alias("open"), F.concat(a["cuts"], F.array(x["i"] + 1)).alias("cuts")))
        .otherwise(a),
        lambda a: a["cuts"],
    )
    return F.concat(F.array(F.lit(0)), folded, F.array(F.size(rows)))


def _pieces(rows: Column, cuts: Column) -> Column:
    def piece(i: Column) -> Column:
        a, b = F.get(cuts, i), F.get(cuts, i + 1)
        end = F.when((b < F.size(rows)) & (b > a), F.lit("\n")).otherwise("")
        return F.struct((i % 2 == 1).alias("inside"), F.concat(join(F.slice(rows, a + 1, b - a)), end).alias("text"))

    return F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), piece)


def outside_fences(op: Op) -> Op:
    """op applied to what lies outside of code fences. Texts without fences are taken whole."""

    def apply(text: Column) -> Column:
        split = F.array_join(F.transform(segments(text), lambda s: F.when(s["inside"], s["text"]).otherwise(op(s["text"]))), "")
        return F.when(text.contains("```") | text.contains("~~~"), split).otherwise(op(text))

    return apply


def count_outside(count: Op) -> Op:
    """The sum of count over what lies outside of code fences."""

    def apply(text: Column) -> Column:
        total = F.aggregate(segments(text), F.lit(0), lambda a, s: a + F.when(s["inside"], F.lit(0)).otherwise(count(s["text"])))
        return F.when(text.contains("```") | text.contains("~~~"), total).otherwise(count(text))

    return apply


# White space


def line_endings(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def trailing_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t]+(?=\n|\z)", "")


def blank_runs(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def _replaced(table: dict[str, str]) -> Op:
    single = {k: v for k, v in table.items() if len(v) == 1}

    def apply(text: Column) -> Column:
        out = F.translate(text, "".join(single), "".join(single.values())) if single else text
        for k, v in table.items():
            if len(v) > 1:
                out = F.replace(out, F.lit(k), F.lit(v))
        return out

    return apply


ligatures, rare_quotes = _replaced(LIGATURES), _replaced(RARE_QUOTES)


def whitespace(text: Column) -> Column:
    """Line ends, trailing blanks, runs of empty lines, ligatures and quotes; composed characters are a matter of nfc()."""
    return outside_fences(lambda s: rare_quotes(ligatures(blank_runs(trailing_blanks(line_endings(s))))))(text)


def whitespace_changes(text: Column) -> Column:
    def count(s: Column) -> Column:
        s = line_endings(s)
        t = trailing_blanks(s)
        special = "[" + "".join([*LIGATURES, *RARE_QUOTES]) + "]"
        return F.regexp_count(s, F.lit(r"[ \t]+(?=\n|\z)")) + F.regexp_count(t, F.lit(r"\n{3,}")) + F.regexp_count(t, F.lit(special))

    return count_outside(count)(text)


# Kerning, page numbers, bullets, lists


def kerning(text: Column) -> Column:
    """C H A P T E R -> CHAPTER in lines of capitals, digits and blanks; gaps of three blanks stay."""
    return outside_fences(lambda s: join(F.transform(F.split(s, "\n"), lambda x: F.when(x.rlike(r"\A\s*[A-Z0-9][A-Z0-9 ]*\s*\z"), F.regexp_replace(x, r"(?<=\b[A-Z0-9]) {1,2}(?=[A-Z0-9]\b)", "")).otherwise(x))))(text)


def kerning_changes(text: Column) -> Column:
    return count_outside(lambda s: F.regexp_count(s, F.lit(r"\b[A-Z0-9](?: {1,2}[A-Z0-9])+\b")))(text)


PAGE_NUMBER = "|".join(PAGE_NUMBER_LINES)


def page_numbers(text: Column) -> Column:
    """Lines that are page numbers become empty."""
    return join(F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(rf"\A(?:{PAGE_NUMBER})\z"), F.lit("")).otherwise(x)))


def page_number_changes(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"\A(?:{PAGE_NUMBER})\z")))


def bullets(text: Column) -> Column:
    return outside_fences(lambda s: F.regexp_replace(s, rf"(?m)^({BLANK}*)[{BULLETS}](?:{BLANK}+|(?=\n))", "$1- "))(text)


ITEM = rf"{BLANK}*\d+[.)]{BLANK}+\S"


def numbered_lists(text: Column) -> Column:
    """Blank lines between two numbered items go."""
    return outside_fences(lambda s: F.regexp_replace(s, rf"(?m)^({ITEM}.*\n)(?:{BLANK}*\n)+(?={ITEM})", "$1"))(text)


def lists(text: Column) -> Column:
    return numbered_lists(bullets(text))


def list_changes(text: Column) -> Column:
    """Lines with bullets mended and blank lines removed."""
    mended = count_outside(lambda s: F.regexp_count(s, F.lit(rf"(?m)^{BLANK}*[{BULLETS}]{BLANK}+")))(text)
    gone = F.regexp_count(bullets(text), F.lit("\n")) - F.regexp_count(lists(text), F.lit("\n"))
    return mended + gone


# Headings


def heading_level(line: Column) -> Column:
    """1 to 3 by the form of a line, 0 where it is none."""
    return (
        F.when((F.trim(line) == "") | line.rlike(r"\A\s*#") | (F.char_length(line) > 200), 0)
        .when(line.rlike(CHAPTER_LINE), 1)
        .when(line.rlike(NUMBERED_3_LINE), 3)
        .when(line.rlike(NUMBERED_2_LINE), 2)
        .when(line.rlike(CAPITALS_LINE), 1)
        .otherwise(0)
    )


def font_level(size: Column, median: Column) -> Column:
    """1 to 4 by the ratio of a line's font size to the body's, 0 below."""
    ratio = size / median
    return F.when((median > 0) & (ratio >= 1.6), 1).when((median > 0) & (ratio >= 1.3), 2).when((median > 0) & (ratio >= 1.15), 3).when((median > 0) & (ratio >= 1.05), 4).otherwise(0)


def headings(text: Column) -> Column:
    """Lines that look like headings get their number signs, and a blank line before, unless one or a heading is there."""

    def marked(x: Column) -> Column:
        return let(heading_level(x), lambda n: F.when(n > 0, F.concat(F.repeat(F.lit("#"), n), F.lit(" "), x)).otherwise(x))

    return let(F.transform(lines(text), marked), blank_before_headings)


def blank_before_headings(array: Column) -> Column:
    def spaced(x: Column, i: Column) -> Column:
        before = at(array, i - 1)
        return F.when(x.startswith("#") & (i > 0) & (F.trim(before) != "") & ~before.startswith("#"), F.concat(F.lit("\n"), x)).otherwise(x)

    return join(F.transform(array, spaced))


def heading_changes(text: Column) -> Column:
    return F.size(F.filter(lines(text), lambda x: heading_level(x) > 0))


def code_state(rows: Column) -> Column:
    """For each line whether it lies in code: any fence line turns code on or off, and counts as turned."""
    folded = F.aggregate(rows, F.array().cast("array<boolean>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(False)) != x.rlike(r"\A\s*(```|~~~)"))))
    return F.when(F.exists(rows, lambda x: x.rlike(r"\A\s*(```|~~~)")), folded).otherwise(F.array_repeat(F.lit(False), F.size(rows)))


def single_h1(text: Column) -> Column:
    """H1s after the first become H2s, outside of code; the count that decides doesn't know of code."""

    def demoted(rows: Column, code: Column) -> Column:
        plain = F.transform(rows, lambda x, i: x.startswith("# ") & ~F.get(code, i))
        return let(plain, lambda p: let(F.array_position(p, True), lambda first: join(F.transform(rows, lambda x, i: F.when(F.get(p, i) & (i + 1 > first), F.concat(F.lit("#"), x)).otherwise(x)))))

    return F.when(h1_count(text) < 2, text).otherwise(let(F.split(text, "\n"), lambda rows: let(code_state(rows), lambda code: demoted(rows, code))))


def h1_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?m)^# "))


# Code


def language(code: Column) -> Column:
    """The language of which most patterns are found in the first five lines, '' for none or a tie. All of it is said once for the head and once for the counts."""

    def counted(head: Column) -> Column:
        return F.array(*(F.struct(sum((head.rlike(p).cast("int") for p in patterns[1:]), head.rlike(patterns[0]).cast("int")).alias("n"), F.lit(name).alias("name")) for name, patterns in LANGUAGES.items()))

    def best(scores: Column) -> Column:
        return let(F.array_max(F.transform(scores, lambda s: s["n"])), lambda top: let(F.filter(scores, lambda s: (s["n"] == top) & (top > 0)), lambda w: F.when(F.size(w) == 1, F.get(w, F.lit(0))["name"]).otherwise("")))

    return let(F.concat(join(F.slice(F.split(code, "\n"), 1, 5)), F.lit("\n")), lambda head: let(counted(head), best))


def is_monospace(font: Column) -> Column:
    """Whether a font's name holds one of the names of fonts with fixed widths, case ignored."""
    return font.rlike("(?i)" + "|".join(MONOSPACE))


def code_kinds(rows: Column, mono: Column | None = None) -> Column:
    """mono for lines that `mono`, an array of booleans, marks, indent for lines of indented code, '' for others; fence
    lines and what they hold are ''."""

    def kind(x: Column, i: Column) -> Column:
        code = x.rlike(r"\A(?:    |\t)") & ~x.rlike(r"\A\s*\z") & ~x.rlike(r"\A\s*(?:```|~~~)") & ~x.rlike(r"\A\s*#{1,6}\s") & ~x.rlike(r"\A\s*(?:[-*+]|\d+[.)])\s")
        plain = F.when(code, F.lit("indent")).otherwise("")
        return plain if mono is None else F.when(F.coalesce(F.get(mono, i), F.lit(False)) & ~x.rlike(r"\A\s*\z"), F.lit("mono")).otherwise(plain)

    return let(code_state(rows), lambda state: F.transform(rows, lambda x, i: F.when(F.get(state, i), F.lit("")).otherwise(kind(x, i))))


def code_blocks(rows: Column, kinds: Column) -> Column:
    """Runs of two or more lines of one kind are put in fences with their language."""

    def framed(rows: Column, kinds: Column, x: Column, i: Column) -> Column:
        kind, before, after = F.get(kinds, i), F.coalesce(at(kinds, i - 1), F.lit("")), F.coalesce(at(kinds, i + 1), F.lit(""))
        head = F.filter(F.slice(F.transform(kinds, lambda k, j: F.struct(k.alias("kind"), j.alias("j"))), i + 1, 5), lambda h: F.forall(F.slice(kinds, i + 1, h["j"] - i + 1), lambda k: k == kind))
        opened = F.when((kind != "") & (before != kind) & (after == kind), F.concat(F.lit("```"), let(join(F.transform(head, lambda h: F.get(rows, h["j"]))), language), F.lit("\n"), x)).otherwise(x)
        return F.when((kind != "") & (before == kind) & (after != kind), F.concat(opened, F.lit("\n```"))).otherwise(opened)

    return let(rows, lambda r: let(kinds, lambda k: F.when(F.exists(k, lambda x: x != ""), join(F.transform(r, lambda x, i: framed(r, k, x, i)))).otherwise(join(r))))


def code_block_changes(kinds: Column) -> Column:
    """Runs of two or more lines of one kind."""
    def starts(k: Column) -> Column:
        return F.size(F.filter(F.sequence(F.lit(0), F.size(k)), lambda i: (F.coalesce(at(k, i), F.lit("")) != "") & (F.coalesce(at(k, i - 1), F.lit("")) != at(k, i)) & at(k, i + 1).eqNullSafe(at(k, i))))

    return let(kinds, starts)


# Footnote markers


def footnote_markers(text: Column) -> Column:
    """Superscript digits, and [n] at the end of a line, become [^n]; equal neighbours are one."""

    def apply(s: Column) -> Column:
        out = s
        for i, c in enumerate(SUPERSCRIPTS):
            out = F.replace(out, F.lit(c), F.lit(f"[^{i}]"))
        out = F.regexp_replace(out, r"\[(\d+)\](?=\s*\z|\s*\n)", "[^$1]")
        return F.regexp_replace(out, r"(\[\^(\d+)\])(?:\s*\[\^\2\])+", "$1")

    return outside_fences(apply)(text)


def footnote_marker_changes(text: Column) -> Column:
    return count_outside(lambda s: F.regexp_count(s, F.lit(f"[{SUPERSCRIPTS}]+")) + F.regexp_count(s, F.lit(r"\[(\d+)\](?=\s*\z|\s*\n)")))(text)


# Paragraphs


def skipped(line: Column) -> Column:
    """Headings, list items, quotes and fences."""
    return line.rlike(SKIPPED_LINE)


def paragraph_joins(text: Column) -> Column:
    """Lines that go on with the paragraph before are joined to it.

    A line is joined to the one before if that is text and doesn't end in . : or ;, and it is text itself that doesn't
    begin with a capital. How a line is written depends on whether it and the next are joined: inner white space of
    all but the last line of a paragraph is collapsed, and a joined paragraph ends in a line end of its own.
    """

    def joined(rows: Column, i: Column) -> Column:
        x, before = at(rows, i), at(rows, i - 1)
        here = ~x.rlike(r"\A\s*\z") & ~skipped(x) & ~x.rlike(r"\A\s*\p{Lu}")
        return F.coalesce((i > 0) & here & ~before.rlike(r"\A\s*\z") & ~skipped(before) & ~before.rlike(r"[.:;]\s*\z"), F.lit(False))

    def written(rows: Column, flags: Column, ended: Column, x: Column, i: Column) -> Column:
        mine, nexts = F.get(flags, i), F.coalesce(at(flags, i + 1), F.lit(False))
        body = F.when(nexts, F.concat(normalize_line(x), F.lit(" "))).when(mine, F.regexp_replace(x, r"\A\s+", "")).otherwise(x)
        end = F.when(nexts, F.lit("")).when((i + 1 < F.size(rows)) | ended, F.lit("\n")).otherwise("")
        return F.concat(body, end, F.when(mine & ~nexts, F.lit("\n")).otherwise(""))

    def apply(s: Column) -> Column:
        ended = s.endswith("\n")
        return let(lines(s), lambda rows: let(F.transform(rows, lambda x, i: joined(rows, i)), lambda flags: F.array_join(F.transform(rows, lambda x, i: written(rows, flags, ended, x, i)), "")))

    return outside_fences(apply)(text)


def text_lines(text: Column) -> Column:
    return F.size(F.filter(lines(text), lambda x: ~x.rlike(r"\A\s*\z")))


def paragraph_join_changes(text: Column) -> Column:
    return F.greatest(F.lit(0), text_lines(text) - text_lines(paragraph_joins(text)))


# Page markers


def insert_markers(pages: Column) -> Column:
    """Pages in one text, with a marker before each but the first."""
    return join(F.transform(pages, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("<!-- page "), (i + 1).cast("string"), F.lit(" -->\n"), p))))


def split_markers(text: Column) -> Column:
    """Pages of a text, without line ends at their ends."""
    return F.transform(F.split(text, MARKER), lambda p: F.regexp_replace(p, r"\A\n+|\n+\z", ""))


def strip_markers(text: Column) -> Column:
    return F.regexp_replace(text, MARKER + r"\n?", "")


# Counts


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\b\w+\b"))


def words_by_space(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def heading_count(text: Column, level: int) -> Column:
    return F.regexp_count(text, F.lit(rf"(?m)^#{{{level}}} "))


def count_diff(before: Column, after: Column) -> Column:
    """How much two texts differ: lines or characters where one is empty, the lengths' difference of single lines, else lines that only one has."""
    return let(lines(before), lambda a: let(lines(after), lambda b: _count_diff(before, after, a, b)))


def _count_diff(before: Column, after: Column, a: Column, b: Column) -> Column:
    apart = F.size(F.array_union(F.array_except(a, b), F.array_except(b, a)))
    return (
        F.when(before == after, 0)
        .when(before == "", F.when(after.contains("\n"), F.size(b)).otherwise(F.char_length(after)))
        .when(after == "", F.when(before.contains("\n"), F.size(a)).otherwise(1))
        .when((F.size(a) == 1) & (F.size(b) == 1), F.abs(F.char_length(after) - F.char_length(before)))
        .otherwise(apart)
    )


# Anchors


def anchor(title: Column) -> Column:
    """Lower case, letters, digits, - and _ kept, other runs one -, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_-]", "-"), r"-{2,}", "-"), r"\A[-_]+|[-_]+\z", "")
