"""Answer grammar: which value a reply gives, in what form, and whether its marks agree.

All functions are column expressions over whole texts.  An extraction is a
struct (value, source, explicit): the marks of a reply are tried in a fixed
order, the last match of a mark counts, and the struct is null where no mark
gives a value.  Digits are ASCII digits; whole numbers and fractions stay exact
up to 38 digits and are left as written beyond.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdikt.functions import rubrics as X
from verdikt.functions import text as T

# Marks of an answer.
TRIPLE = r"\*{3}([^*]+?)\*{3}"
BOLD = r"\*\*([^*]+)\*\*"
ANSWER_LINE = (
    r"(?:final answer|answer|thus(?:,)?(?: the)? answer is|therefore(?:,)?(?: the)? answer is|i (?:select|choose))"
    r"\s*[:\-]?\s*(.+)$"
)
FINAL_MARK = r"FINAL[_\s]?ANSWER\s*[:\-]\s*([^\n]+)"
PHRASE_MARK = r"(?:final\s+answer|the\s+answer\s+is|final:|answer:)\s*[:\-]?\s*([^\n.]+)"
BOXED = r"\\boxed\s*\{([^}]+)\}"
NUMBER = r"-?[0-9]+(?:[/.][0-9]+)?"
LEADING = (
    r"^(?:thus|so|hence|therefore|the\s+answer\s+is|final\s+answer\s+is|final\s+answer\s*[:\-]|answer\s*[:\-]|"
    r"thus\s+final\s+concluding\s+answer\s+is|repeat\s+the\s+answer\s+\w+\s+times[^:]*:)\s*"
)
CUE = r"(?:letter|option|answer|string|choice)\s*[(\[{\"']?([a-j])[)\]}\"']?"
OUTER = ".,;:!?\"'`()[]{}\\$"
HEADINGS = ("answer", "final answer", "conclusion", "bold conclusion", "answers")
LATEX_SPACES = ("\\textbf{", "\\mathbf{", "\\boxed{", "\\qquad", "\\quad", "~", "{", "}")
LAST_CHARS = 500
BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"  # line breaks beside the line feed

_JAVA = "(?U)"
_LINES = "(?imdU)^"


def found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def repeated(c: Column, least: int, most: int | None = None, letters: str = "A-Ja-j") -> Column:
    """Words that are one letter, ``least`` to ``most`` times."""
    upper = "" if most is None else str(most - 1)
    return found(c, rf"(?<![\p{{L}}\p{{N}}_])(([{letters}])\2{{{least - 1},{upper}}})(?![\p{{L}}\p{{N}}_])")


def closing_line(text: Column) -> Column:
    """The last line that is not blank, stripped; '' without one."""
    return T.strip(F.substring_index(T.strip(F.translate(text, BREAKS, "\n" * len(BREAKS))), "\n", -1))


def marked(text: Column, pattern: str, *cues: str) -> Column:
    """First match of a mark, sought only where one of its literal cues stands."""
    return F.when(T.has_any(F.lower(text), cues), first(found(text, "(?i)" + _JAVA + pattern)))


def outer_stripped(c: Column) -> Column:
    return T.strip(F.btrim(T.strip(c), F.lit(OUTER)))


def extraction(value: Column, source: str, explicit: bool) -> Column:
    """A struct where ``value`` is not null; an empty one still ends the search."""

    def made(v: Column) -> Column:
        told = F.struct(X.exact_answer_value(v).alias("value"), F.lit(source).alias("source"), F.lit(explicit).alias("explicit"))
        return F.when(v.isNotNull(), told)

    return T.let(value, made)


def answer_segments(text: Column) -> dict[str, Column]:
    """The last span or line of each mark; null without one."""
    line = F.nullif(closing_line(text), F.lit(""))
    return {
        "triple_asterisk_span": last(found(text, TRIPLE)),
        "bold_span": last(found(text, BOLD)),
        "final_answer_line": last(found(text, _LINES + ANSWER_LINE)),
        "last_line": line,
    }


def exact_answer(text: Column, question: Column, reference: Column) -> Column:
    """(value, source, explicit) of a reply to a question with an optional reference answer."""
    marks = answer_segments(text)
    parts = F.struct(
        text.alias("text"), F.contains(F.lower(question), F.lit("single phrase")).alias("phrase"),
        X.exact_answer_value(reference).alias("ref"), X.answer_mode(question, reference).alias("mode"),
        *[segment.alias(source) for source, segment in marks.items()],
    )
    return T.let(parts, lambda x: T.let(_by_mode(x, list(marks)), lambda best: F.when(best["value"] != "", best)))


def _by_mode(x: Column, sources: list[str]) -> Column:
    spans = sources[:-1]

    def same(value: Column) -> Column:
        """The normalised value if it is one letter as often as in the reference."""
        fits = lambda v: v.rlike(r"^([a-j])\1{0,9}$") & (F.length(v) == F.length(x["ref"]))
        return T.let(X.exact_answer_value(value), lambda v: F.when(fits(v), v))

    def of_length(value: Column) -> Column:
        return last(F.filter(repeated(value, 1, 10), lambda w: F.length(w) == F.length(x["ref"])))

    def choice(segment: Column) -> Column:
        return F.coalesce(last(repeated(segment, 2, 10)), last(repeated(segment, 1, 1)))

    def entire() -> Column:
        return T.let(X.exact_answer_value(x["text"]), lambda v: F.when(v.rlike(r"^([a-j])\1{1,9}$"), v))

    by_reference = F.coalesce(
        extraction(same(x["text"]), "entire_response", True),
        *[extraction(same(x[s]), s, True) for s in spans if s != "final_answer_line"],
        extraction(of_length(x["final_answer_line"]), "final_answer_line", True),
        extraction(same(x["last_line"]), "last_line", True),
        extraction(of_length(x["text"]), "inline_repeated_choice", False),
    )
    by_letter = F.coalesce(
        extraction(entire(), "entire_response", True),
        *[extraction(choice(x[s]), s, True) for s in sources],
        extraction(last(repeated(x["text"], 2, 10)), "inline_repeated_choice", False),
    )
    integer = r"(-?[0-9]+)"
    digits = (x["ref"] == "") & (x["mode"] == "single_digit")
    whole_line = x["phrase"] | ((x["ref"] == "") & x["mode"].isin("single_word", "single_phrase", "decorated_span"))
    line = F.when(digits, last(found(x["last_line"], integer))).when(whole_line, x["last_line"])
    by_mark = F.coalesce(
        *[extraction(x[s], s, True) for s in spans],
        extraction(line, "last_line", True),
        extraction(F.when(digits, last(found(x["text"], integer))), "inline_integer", False),
    )
    one_letter = x["ref"].rlike(r"^([a-j])\1{0,9}$")
    return F.when(one_letter, by_reference).when((x["ref"] == "") & (x["mode"] == "repeated_choice"), by_letter).otherwise(by_mark)


def lowest_terms(token: Column) -> Column:
    """A fraction in lowest terms, a number without needless zeros, 8 places at most; '' where it is neither."""
    top, bottom = F.split_part(token, F.lit("/"), F.lit(1)), F.split_part(token, F.lit("/"), F.lit(2))
    wide = "decimal(38,0)"
    step = F.struct(F.abs(top.try_cast(wide)).alias("a"), bottom.try_cast(wide).alias("b"))
    # Euclid's algorithm as a fold; 38 digits take fewer than 184 steps
    common = F.aggregate(
        F.sequence(F.lit(1), F.lit(184)), step,
        lambda x, _: F.when(x["b"] == 0, x).otherwise(F.struct(x["b"].alias("a"), F.try_mod(x["a"], x["b"]).cast(wide).alias("b"))),
        lambda x: x["a"],
    )

    def reduced(divisor: Column) -> Column:
        n, d = top.try_cast(wide), bottom.try_cast(wide)
        shown = F.concat(_divided(n, divisor), F.lit("/"), _divided(d, divisor))
        return F.when(n.isNull() | d.isNull() | (d == 0), token).otherwise(shown)

    whole = F.regexp_replace(F.regexp_replace(token, r"^(-?)0+(?=[0-9])", "$1"), r"^-0$", "0")
    places = F.round(token.try_cast("decimal(38,12)"), 8).cast("string")
    short = F.regexp_replace(F.regexp_replace(places, r"0+$", ""), r"\.$", "")
    tidy = F.coalesce(F.when(short == "-0", "0").otherwise(short), token)
    return (
        F.when(F.contains(token, F.lit("/")), T.let(common, reduced))
        .when(F.contains(token, F.lit(".")), tidy)
        .otherwise(whole)
    )


def _divided(n: Column, divisor: Column) -> Column:
    """Exact quotient as text; both are whole and the divisor divides n."""
    return F.regexp_replace(F.try_divide(n, divisor).cast("decimal(38,0)").cast("string"), r"\.0+$", "")


def canonical_answer(raw: Column) -> Column:
    """Comparable form: boxed content, repeated letters, option letter, last number, else the plain text."""
    boxed = first(found(raw, BOXED))
    bare = T.strip(F.regexp_replace(T.strip(F.coalesce(boxed, raw)), "(?i)" + _JAVA + LEADING, ""))

    def form(c: Column) -> Column:
        long_run = first(repeated(c, 5, letters="a-z"))
        number = last(found(c, f"({NUMBER})"))
        return (
            F.when(long_run.isNotNull(), long_run)
            .when(c.rlike(r"^([a-z])\1{2,}$") | c.rlike("^[a-z]$"), c)
            .when(number.isNotNull(), lowest_terms(number))
            .otherwise(c)
        )

    return F.coalesce(T.let(F.lower(outer_stripped(bare)), form), F.lit(""))


def final_value(text: Column) -> Column:
    """What a worked solution gives as its result, as written but for outer marks."""
    line = closing_line(text)
    value = F.coalesce(
        outer_stripped(marked(text, FINAL_MARK, "answer")),
        outer_stripped(last(found(text, BOXED))),
        last(repeated(text, 5, letters="A-Za-z")),
        outer_stripped(marked(text, PHRASE_MARK, "answer", "final:")),
        last(found(F.right(text, F.lit(LAST_CHARS)), f"({NUMBER})")),
        outer_stripped(line),
    )
    return F.coalesce(value, F.lit(""))


def plain_answer(raw: Column) -> Column:
    """Lower case without asterisks and closing marks, comma lists with one blank after each comma."""
    bare = F.rtrim(T.strip(F.lower(F.replace(T.strip(raw), F.lit("*"), F.lit("")))), F.lit(".,!?;:"))
    parts = F.filter(F.transform(F.split(T.squeeze(bare), ","), T.strip), lambda p: p != "")
    return F.when(F.size(parts) > 1, F.array_join(parts, ", ")).otherwise(T.squeeze(bare))


def reasoned_answer(text: Column) -> Column:
    """Answer of a free reply: the final mark, the last bold span that is no heading, the last line."""
    bold = F.filter(
        F.transform(found(text, r"\*\*([^*]+?)\*\*"), T.strip),
        lambda b: (b != "") & ~F.lower(b).rlike("^(?:" + "|".join(HEADINGS) + ")"),
    )
    picked = F.coalesce(marked(text, FINAL_MARK, "answer"), last(bold), closing_line(text))
    return F.coalesce(plain_answer(picked), F.lit(""))


def question_choices(question: Column) -> Column:
    """(letter, value) of the options a question lists, one a letter, in order of letters; empty below two."""
    plain = question
    for mark in LATEX_SPACES:
        plain = F.replace(plain, F.lit(mark), F.lit(" "))
    plain = T.squeeze(plain)

    def options(pattern: str) -> Column:
        parts = F.split(F.regexp_replace(plain, pattern, "\x01$1\x02"), "\x01")
        listed = F.transform(
            F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: F.contains(p, F.lit("\x02"))),
            lambda p: F.struct(
                F.lower(F.split_part(p, F.lit("\x02"), F.lit(1))).alias("letter"),
                X.exact_answer_value(F.btrim(F.split_part(p, F.lit("\x02"), F.lit(2)), F.lit(" :-.;,"))).alias("value"),
            ),
        )
        kept = F.filter(listed, lambda o: o["value"] != "")
        by_letter = F.transform(
            F.array_sort(F.array_distinct(F.transform(kept, lambda o: o["letter"]))),
            lambda letter: F.element_at(F.filter(kept, lambda o: o["letter"] == letter), -1),
        )
        return F.when(F.size(by_letter) >= 2, by_letter)

    none = F.array().cast("array<struct<letter:string,value:string>>")
    return F.coalesce(options(r"\(([A-Ja-j])\)"), options(r"(?:(?<=\s)|^)([A-Ja-j])[).:]\s+"), none)


def explicit_segments(text: Column) -> Column:
    """All answer lines, spans and the last line, squeezed; of those equal but for case the first."""
    line = closing_line(text)
    parts = F.concat(found(text, _LINES + ANSWER_LINE), found(text, TRIPLE), found(text, BOLD), F.array(line))
    clean = F.filter(F.transform(parts, T.squeeze), lambda s: s != "")

    def distinct(values: Column) -> Column:
        lowered = F.transform(values, F.lower)
        return T.let(lowered, lambda low: F.filter(values, lambda s, i: F.array_position(low, F.lower(s)) == i + 1))

    return T.let(clean, distinct)


def choice_letters(segment: Column, choices: Column) -> Column:
    """Option letters that a segment names, repeats or spells out."""
    low = F.lower(T.squeeze(segment))
    return F.array_distinct(F.concat(
        F.transform(repeated(low, 2, 10, "a-j"), lambda w: F.substring(w, 1, 1)),
        found(low, _JAVA + CUE),
        F.when(low.rlike("^[a-j]$"), F.array(low)).otherwise(F.array().cast("array<string>")),
        named_choices(low, choices),
    ))


def named_choices(low: Column, choices: Column) -> Column:
    said = F.filter(choices, lambda o: (F.length(o["value"]) > 1) & F.contains(low, o["value"]))
    return F.transform(said, lambda o: o["letter"])


def answer_signal(text: Column, question: Column, reference: Column, choices: Column) -> Column:
    """Struct of what the marks of a reply say together.

    value and explicit are those of ``exact_answer``; format_ok asks for the form
    the question wants, consistent that no mark contradicts another, and
    marker_count counts the different values and letters.  ``choices`` must be a
    column, because the lambdas look into it.
    """

    def judged(answer: Column, segments: Column) -> Column:
        value = F.coalesce(answer["value"], F.lit(""))
        explicit = F.coalesce(answer["explicit"], F.lit(False))
        values = F.array_distinct(F.filter(
            F.transform(segments, lambda s: exact_answer(s, question, reference)["value"]), lambda v: v.isNotNull()
        ))
        letters = F.array_distinct(F.flatten(F.transform(segments, lambda s: choice_letters(s, choices))))
        response = F.array_distinct(named_choices(F.lower(T.squeeze(text)), choices))
        letters = F.when(F.size(response) == 1, F.array_union(letters, response)).otherwise(letters)
        final = F.when(value.rlike(r"^([a-j])\1{0,9}$"), F.substring(value, 1, 1))
        has_map = F.size(choices) > 0

        def decided(letters: Column) -> Column:
            off = F.when(final.isNull(), False).otherwise(~F.array_contains(letters, F.coalesce(final, F.lit(""))))
            conflicting = (F.size(values) > 1) | (has_map & (F.size(letters) > 0) & ((F.size(letters) > 1) | off))
            ref = X.exact_answer_value(reference)
            needed = F.when(ref.rlike(r"^([a-j])\1{0,9}$"), F.length(ref)).otherwise(
                F.when(F.contains(F.lower(question), F.lit("five times")), 5).otherwise(2)
            )
            one_letter = value.rlike(r"^(.)\1*$") & (F.length(value) >= needed)
            wanted = F.when(X.answer_mode(question, reference) == "repeated_choice", one_letter).otherwise(F.lit(True))
            marks = F.array_union(F.array_union(values, letters), F.when(final.isNull(), F.array().cast("array<string>")).otherwise(F.array(final)))
            return F.struct(
                value.alias("value"), explicit.alias("explicit"), (explicit & (value != "") & wanted).alias("format_ok"),
                (explicit & ~conflicting).alias("consistent"), has_map.alias("option_map"),
                conflicting.alias("conflicting"), F.size(marks).cast("long").alias("marker_count"),
            )

        return T.let(letters, decided)

    return T.let(
        F.struct(exact_answer(text, question, reference).alias("answer"), explicit_segments(text).alias("segments")),
        lambda x: judged(x["answer"], x["segments"]),
    )
