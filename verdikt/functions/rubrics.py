"""Rubric text, answer extraction, degradation and mapping expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdikt.functions import text as T

# Requirement prefixes by polarity; each also occurs after "the ".
POSITIVE_VERBS = ("includes", "documents", "specifies", "contains", "records", "preserves", "states",
                  "orders", "addresses")
NEGATIVE_VERBS = ("avoids", "does not", "should not", "must not", "excludes")

# Words ignored when two requirements are compared.
RUBRIC_STOPWORDS = (
    "the", "note", "patient", "and", "with", "that", "from", "this", "into", "only", "when", "they",
    "were", "their", "does", "doesnt", "should", "must", "have", "has", "been", "being", "part",
    "plan", "plans", "consistent", "transcript", "discussion", "described", "documented",
)
# Words ignored when criteria of two sources are aligned.
FAMILY_STOPWORDS = (
    "the", "and", "for", "that", "this", "with", "from", "when", "must", "should", "would", "include",
    "including", "document", "documents", "note", "response", "patient", "clinical", "medical",
    "health", "care", "task", "same", "given", "based", "there", "their", "about", "into", "than",
    "them", "they", "your", "have", "has", "been", "being", "under", "only", "just", "more", "less", "very",
)
# Words ignored in salient phrases.
DISCOVERY_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "better", "by", "clear", "clearly", "detail", "details",
    "document", "documentation", "documented", "encounter", "for", "from", "here", "in", "include",
    "included", "includes", "is", "it", "main", "matters", "more", "must", "note", "patient", "present",
    "quality", "should", "shows", "specific", "states", "statement", "that", "the", "their", "there",
    "this", "thorough", "to", "visit", "with",
)
# Dimensions and hints that call for decomposition.
GENERIC_DIMENSIONS = (
    "", "content_coverage", "completeness", "final_response_quality", "format_communication",
    "grounding", "instruction_adherence", "reasoning_support", "source_grounding", "task_completion",
)
BROAD_HINTS = (
    "content coverage", "completeness", "overall quality", "main next steps", "general quality",
    "requested details", "requested format", "key details", "all relevant", "main instructions",
)
# Profile cues in routing order, as substrings and as whole words.
SUBSTRING_PROFILES = (
    ("note_documentation", ("healthcare scribe",)),
    ("documentation_variants", ("discharge", "progress note", "pre-op", "preop", "summary", "handoff",
                                "patient message", "alert")),
    ("rewrite_editing", ("rewrite", "rephrase", "edit", "grammar", "proofread", "tone", "shorten", "expand")),
    ("clinical_decision_support", ("differential", "recommendation", "next step", "management plan",
                                   "triage", "workup")),
    ("agentic_workflows", ("tool result", "workflow", "step by step", "failure", "retry", "verification", "agent")),
)
WORD_PROFILES = (
    ("note_documentation", ("healthcare scribe", "medical note", "soap note", "clinical note", "transcript")),
    ("documentation_variants", ("discharge", "progress note", "pre-op", "preop", "summary", "handoff",
                                "patient message", "alert")),
    ("rewrite_editing", ("rewrite", "rephrase", "edit", "grammar", "proofread", "tone", "style", "shorten", "expand")),
    ("clinical_decision_support", ("differential", "recommendation", "next step", "management plan",
                                   "triage", "workup", "assessment")),
    ("agentic_workflows", ("workflow", "tool result", "observation", "retry", "verification", "failed step", "agent")),
)
DEFAULT_PROFILE = "general_instruction_following"
# Words that drop a line when plan details are removed.
PLAN_WORDS = "follow up|follow-up|assessment|plan|medication|treatment"
# Fixed value: the sentence appended by the certainty mutation.
CERTAINTY_ADDENDUM = (
    "\n\nAddendum: Findings are pathognomonic for the working diagnosis per clinical assessment."
)
YES_WORDS = ("YES", "Y", "TRUE", "PASS")
NO_WORDS = ("NO", "N", "FALSE", "FAIL")
LABEL_A = ("a", "reference_answer_a", "response_a", "answer_a", "candidate_a", "pair_response_a")
LABEL_B = ("b", "reference_answer_b", "response_b", "answer_b", "candidate_b", "pair_response_b")


def polarity(c: Column) -> Column:
    """negative / positive / neutral by requirement prefix, negatives first."""
    low = F.lower(T.squeeze(c))
    neg = "^(the )?note (" + "|".join(NEGATIVE_VERBS) + ")"
    pos = "^(the )?note (" + "|".join(POSITIVE_VERBS) + ")"
    return F.when(low.rlike(neg), "negative").when(low.rlike(pos), "positive").otherwise("neutral")


def _literal_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def content_tokens(c: Column) -> Column:
    """Distinct alphanumeric words longer than two characters, minus stop words."""
    # one pass over the text; array_except leaves distinct words in order
    long_words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.array_except(long_words, _literal_array(RUBRIC_STOPWORDS))


def family_tokens(c: Column) -> Column:
    """Distinct tokens of four or more characters, minus alignment stop words."""
    long_words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{4,}"), F.lit(0))
    return F.array_except(long_words, _literal_array(FAMILY_STOPWORDS))


def word_set(c: Column) -> Column:
    """Distinct lowercase whitespace-separated words."""
    return F.array_distinct(T.words(F.lower(T.squeeze(c))))


def overlaps(new_words: Column, old_words: Column, threshold: float = 0.7) -> Column:
    # sets of too different a size cannot reach the threshold: tested before the costly intersection
    a, b = F.size(new_words), F.size(old_words)
    fits = F.least(a, b) / F.greatest(a, b, F.lit(1)) >= threshold
    return (a > 0) & (b > 0) & fits & (T.jaccard(new_words, old_words) >= threshold)


def conflicts(new_pol: Column, new_tok: Column, old_pol: Column, old_tok: Column, threshold: float = 0.6) -> Column:
    opposite = (new_pol != "neutral") & (old_pol != "neutral") & (new_pol != old_pol)
    return opposite & (F.size(new_tok) > 0) & (F.size(old_tok) > 0) & (
        T.overlap_min(new_tok, old_tok) >= threshold
    )


def extract_rubrics(c: Column) -> Column:
    """<RUBRIC> blocks, else bullet-stripped lines of at least twelve characters."""
    tagged = F.filter(
        F.transform(F.regexp_extract_all(c, F.lit(r"(?is)<RUBRIC>\s*(.*?)\s*</RUBRIC>"), F.lit(1)), T.squeeze),
        lambda x: x != "",
    )
    plain = F.transform(
        F.filter(
            F.transform(T.lines(c), lambda x: T.strip(F.regexp_replace(x, r"^[\-\*\d\.\)\s]+", ""))),
            lambda x: F.length(x) >= 12,
        ),
        T.squeeze,
    )
    has_tags = c.rlike(r"(?is)<RUBRIC>.*?</RUBRIC>")
    return F.when(has_tags, tagged).otherwise(plain)


def strip_fences(c: Column) -> Column:
    s = T.strip(c)
    opened = T.strip(F.regexp_replace(s, r"^```[a-zA-Z0-9_-]*", ""))
    return F.when(s.startswith("```"), T.strip(F.regexp_replace(opened, r"```\z", ""))).otherwise(s)


def json_object(c: Column) -> Column:
    """The JSON object in a reply: the whole cleaned text, else the widest braces."""
    clean = strip_fences(c)
    whole = F.when(clean.rlike(r"(?s)^\{.*\}\z"), clean)
    return F.coalesce(whole, F.nullif(F.regexp_extract(clean, r"(?s)\{.*\}", 0), F.lit("")))


def tagged_value(c: Column, tag: str) -> Column:
    return F.regexp_extract(c, rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>", 1)


def _verdict(word: Column) -> Column:
    return F.when(word.isin(*YES_WORDS), True).when(word.isin(*NO_WORDS), False)


def parse_yes_no(c: Column) -> Column:
    """JSON verdict, then tag, then first token; NULL when nothing is readable."""
    obj = json_object(c)
    fields = [
        _verdict(F.upper(T.strip(F.get_json_object(obj, f"$.{k}"))))
        for k in ("verdict", "evaluation", "label", "answer")
    ]
    first = F.element_at(F.concat(T.words(F.upper(strip_fences(c))), F.array(F.lit(""))), 1)
    return F.coalesce(*fields, _verdict(F.upper(tagged_value(c, "EVALUATION"))), _verdict(first))


def pair_label(c: Column) -> Column:
    """'a', 'b' or '' from aliases; text '0'/'1' is not a label, numbers are."""
    low = F.lower(T.strip(c))
    return F.when(low.isin(*LABEL_A), "a").when(low.isin(*LABEL_B), "b").otherwise("")


def numeric_pair_label(n: Column) -> Column:
    return F.when(n == 0, "a").when(n == 1, "b").otherwise("")


def profile_by_substring(blob: Column, is_note: Column | None = None) -> Column:
    low = F.lower(blob)
    note = T.has_any(low, SUBSTRING_PROFILES[0][1])
    out = F.when(note if is_note is None else (note | is_note), SUBSTRING_PROFILES[0][0])
    for name, cues in SUBSTRING_PROFILES[1:]:
        out = out.when(T.has_any(low, cues), name)
    return out.otherwise(DEFAULT_PROFILE)


def profile_by_words(blob: Column) -> Column:
    low = F.lower(T.squeeze(blob))
    out = None
    for name, cues in WORD_PROFILES:
        hit = T.has_any_phrase(low, cues)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(DEFAULT_PROFILE)


def truncate_half(c: Column) -> Column:
    """First half of the paragraphs (at least one)."""
    parts = F.filter(F.transform(F.split(c, r"\n\s*\n"), T.strip), lambda x: x != "")
    half = T.let(parts, lambda p: F.slice(p, 1, F.greatest(F.lit(1), F.floor(F.size(p) / 2).cast("int"))))
    return T.strip(F.array_join(half, "\n\n"))


def remove_plan_details(c: Column) -> Column:
    kept = F.filter(T.lines(c), lambda x: ~x.rlike(f"(?i){PLAN_WORDS}"))
    return T.strip(F.regexp_replace(T.strip(F.array_join(kept, "\n")), r"\b\d+(\.\d+)?\b", "[unspecified]"))


def drop_lines(c: Column, pattern: str) -> Column:
    """Remove matching lines; unchanged when none or all of the text would go."""
    def keep(rows):
        return T.let(F.filter(rows, lambda x: ~x.rlike(pattern)), lambda kept: F.when(
            F.size(kept) < F.size(rows), F.nullif(F.array_join(kept, "\n"), F.lit(""))))

    left = T.let(T.lines(c), keep)
    return F.when(T.strip(F.coalesce(left, F.lit(""))) == "", c).otherwise(left)


def inflate_certainty(c: Column) -> Column:
    return T.strip(F.concat(F.regexp_replace(c, f"{T.SPACE}+\\z", ""), F.lit(CERTAINTY_ADDENDUM)))


def line_delta(strong: Column, weak: Column) -> Column:
    """Struct of raw lines whose normal form occurs on one side only."""
    def pairs(c):
        rows = F.transform(T.full_lines(c), lambda x: F.struct(T.matched_text(x).alias("norm"), x.alias("raw")))
        return F.filter(rows, lambda p: p["norm"] != "")

    def only(left, right):
        return T.let(F.transform(right, lambda p: p["norm"]), lambda norms: F.transform(
            F.filter(left, lambda p: ~F.array_contains(norms, p["norm"])), lambda p: p["raw"]))

    return T.let(
        F.struct(pairs(strong).alias("s"), pairs(weak).alias("w")),
        lambda v: F.struct(only(v["s"], v["w"]).alias("strong_only"), only(v["w"], v["s"]).alias("weak_only")),
    )


def salient_terms(c: Column, limit: int = 18) -> Column:
    """Distinct 3-grams, then 2-grams, then long words, first ``limit``."""
    toks = F.filter(
        T.alnum_tokens(F.translate(c, "_", " ")),
        lambda t: (F.length(t) >= 4) & ~t.isin(*DISCOVERY_STOPWORDS),
    )

    def grams(k: Column, width: int) -> Column:
        count = F.size(k) - width + 1
        spots = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(spots, lambda i: F.array_join(F.slice(k, i, width), " "))

    def terms(k: Column) -> Column:
        longer = F.filter(k, lambda t: F.length(t) >= 7)
        return F.slice(F.array_distinct(F.concat(grams(k, 3), grams(k, 2), longer)), 1, limit)

    return T.let(toks, terms)


def decomposition_reason(dimension: Column, label: Column, requirement: Column,
                         guided: bool = False) -> Column:
    """Why a proposal should be decomposed, or NULL."""
    dim = F.lower(T.squeeze(dimension))
    blob = F.lower(T.squeeze(F.concat_ws(" ", dimension, label, requirement)))
    generic = dim.isin(*GENERIC_DIMENSIONS)
    broad = T.has_any(blob, BROAD_HINTS)
    low = F.lower(requirement)
    markers = T.count_of(low, " and ") + T.count_of(low, ";") + T.count_of(low, ", ")
    # tokens here are counted on the text as written: capitals split words
    n_words = F.size(F.filter(F.split(F.concat_ws(" ", label, requirement), "[^a-z0-9]+"), lambda t: t != ""))
    return (
        F.when(generic & F.lit(guided), "calibration_guided_generic_parent")
        .when(generic & broad, "generic_dimension_broad_requirement")
        .when(broad, "broad_label_or_requirement")
        .when(markers >= 2, "compound_requirement")
        .when(n_words >= 18, "long_requirement")
        .when(generic & (n_words >= 12), "generic_dimension")
    )


def severity_tier(c: Column) -> Column:
    s = F.lower(T.squeeze(c))
    return (
        F.when(s == "", "optional")
        .when(F.contains(s, F.lit("hard_gate")) | s.isin("hard", "gate"), "catastrophic")
        .when(F.contains(s, F.lit("high")), "essential")
        .when(F.contains(s, F.lit("medium")), "important")
        .otherwise("optional")
    )


def capped_tier(tier: Column) -> Column:
    return F.when(tier == "catastrophic", "essential").when(tier == "", "optional").otherwise(tier)


def exact_answer_value(c: Column) -> Column:
    """Answer text without fences, bold marks and outer punctuation, lowercased."""
    s = T.strip(c)
    s = F.when(s.startswith("```") & s.endswith("```"), T.strip(F.btrim(s, F.lit("`")))).otherwise(s)
    bold = s.startswith("**") & s.endswith("**") & (F.length(s) > 4)
    s = F.when(bold, F.substring(s, F.lit(3), F.length(s) - 4)).otherwise(s)
    return F.lower(T.squeeze(F.btrim(s, F.lit("`*_ \t\r\n.,:;!?\"'"))))


def answer_mode(question: Column, reference: Column) -> Column:
    q, ref = F.lower(question), exact_answer_value(reference)
    repeated = "^(" + "|".join(f"{ch}{{1,10}}" for ch in "abcdefghij") + ")$"
    return (
        F.when(ref.rlike(repeated) | F.contains(q, F.lit("duplicate that letter five times")), "repeated_choice")
        .when(T.has_any(q, ("***", "bold", "double asterisks")), "decorated_span")
        .when(T.has_any(q, ("single digit",)), "single_digit")
        .when(T.has_any(q, ("single phrase",)), "single_phrase")
        .when(T.has_any(q, ("single word", "single string")), "single_word")
        .otherwise("")
    )


def last_line(c: Column) -> Column:
    rows = T.full_lines(c)
    return F.when(F.size(rows) > 0, F.element_at(rows, -1)).otherwise("")


def answer_letter(c: Column) -> Column:
    """Option letter: marker, repeated letter, phrase, last bracketed letter near the end."""
    marker = F.regexp_extract(c, r"(?i)FINAL[_\s]?ANSWER\s*[:\-]\s*([A-Za-z])\b", 1)
    repeated = F.regexp_extract(c, r"\b([A-Ja-j])\1{4,}\b", 1)
    phrase = F.regexp_extract(
        c, r"(?i)(?:final\s+answer|the\s+answer\s+is|answer\s*[:\-])\s*[:\-]?\s*\(?([A-Ja-j])\)?", 1
    )
    tail = F.regexp_extract_all(F.substring(c, -500, 500), F.lit(r"\(([A-Ja-j])\)"), F.lit(1))
    bracket = F.when(F.size(tail) > 0, F.element_at(tail, -1)).otherwise("")
    pick = F.coalesce(*[F.nullif(x, F.lit("")) for x in (marker, repeated, phrase, bracket)], F.lit(""))
    return F.upper(pick)


def outputs_match(actual: Column, expected: Column) -> Column:
    """Equal tokens, or the expected tokens are a prefix of the actual ones."""
    a, e = T.words(actual), T.words(expected)
    return F.when(F.size(e) == 0, F.size(a) == 0).otherwise(F.slice(a, 1, F.greatest(F.size(e), F.lit(1))) == e)


def short_id(example_id: Column) -> Column:
    """Text after the first double underscore."""
    at = F.instr(example_id, "__")
    return F.when(at > 0, F.substring(example_id, at + 2, F.length(example_id))).otherwise(example_id)


def candidate_role(origin: Column, label: Column) -> Column:
    anchor = origin == "pair_anchor"
    return (
        F.when(anchor & label.endswith("_a"), "pair_anchor_a")
        .when(anchor & label.endswith("_b"), "pair_anchor_b")
        .when(anchor, "pair_anchor")
        .when((origin == "generated") & (F.coalesce(label, F.lit("")) != ""), label)
        .when(F.coalesce(origin, F.lit("")) == "", "unknown")
        .otherwise(origin)
    )


def head_phrase(c: Column, n: int = 4) -> Column:
    cleaned = F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " ")
    return F.array_join(F.slice(F.filter(F.split(cleaned, r"\s+"), lambda t: t != ""), 1, n), " ")


def text_digest(c: Column) -> Column:
    """Whitespace-squeezed lowercase text as an identity: sha1 prefix."""
    return F.substring(F.sha1(F.lower(T.squeeze(c))), 1, 16)


def criterion_fingerprint(*cols: Column) -> Column:
    return F.substring(F.sha1(F.lower(F.concat_ws("|", *cols))), 1, 16)


def template_id(merge_key: Column) -> Column:
    return F.concat(F.lit("discovered__"), F.substring(F.sha2(merge_key, 256), 1, 16))


def heuristic_satisfaction(note: Column, bucket: Column, rubric: Column) -> Column:
    """Offline yes/no rule for a rubric text when no judge verdict is cached."""
    return satisfied(F.lower(note), bucket, F.lower(rubric))


def satisfied(n: Column, bucket: Column, r: Column) -> Column:
    """``heuristic_satisfaction`` of a note and a rubric in lower case."""
    return (
        F.when(T.has_any(r, ("chief complaint", "visit reason")),
               T.has_any(n, ("chief complaint", "history of present illness", "cc:")))
        .when(F.contains(r, F.lit("medication")),
              n.rlike(r"\bmg\b|medication|aspirin|lisinopril|atorvastatin|metformin"))
        .when(T.has_any(r, ("follow-up", "referral", "next step")),
              T.has_any(n, ("follow up", "follow-up", "return", "referral")))
        .when(F.contains(r, F.lit("unsupported")), ~bucket.isin("synthetically_degraded", "note_truncated"))
        .when(T.has_any(r, ("structure", "section")),
              T.has_any(n, ("assessment", "plan", "history", "review of systems", "objective", "subjective",
                            "chief complaint")))
        .otherwise(bucket.isin("gold_like", "strong_anchor", "frontier_generated"))
    )


def example_key(source: Column, source_id: Column, row_index: Column) -> Column:
    left = F.translate(F.lower(source), " -", "__")
    right = F.coalesce(F.nullif(F.translate(T.strip(source_id), " ", "_"), F.lit("")), row_index.cast("string"))
    return F.concat(left, F.lit("__"), right)


def overall_decision(hard_unmet: Column, hard_unknown: Column, soft_mean: Column, minimum: Column) -> Column:
    return (
        F.when(hard_unmet, "do_not_train").when(hard_unknown, "repair")
        .when(F.coalesce(soft_mean, F.lit(1.0)) < minimum, "repair").otherwise("sft_include")
    )


def training_bucket(overall: Column) -> Column:
    return F.when(overall == "sft_include", "gold_sft").otherwise(overall)
