"""String scalars: parsing, normalising and measuring answers and turns.

All are Column -> Column and stay in the JVM.  White space is trimmed by
pattern, because SQL ``trim`` takes blanks only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Replacements of the answer normaliser, in order.
SUBSTITUTIONS = [
    ("an ", ""),
    ("a ", ""),
    (".$", "$"),
    ("\\$", ""),
    ("\\ ", ""),
    (" ", ""),
    ("mbox", "text"),
    (",\\text{and}", ","),
    ("\\text{and}", ","),
    ("\\text{m}", "\\text{}"),
]
# Expressions that the answer normaliser removes, in order.
REMOVED_EXPRESSIONS = [
    "square",
    "ways",
    "integers",
    "dollars",
    "mph",
    "inches",
    "ft",
    "hours",
    "km",
    "units",
    "\\ldots",
    "sue",
    "points",
    "feet",
    "minutes",
    "digits",
    "cents",
    "degrees",
    "cm",
    "gm",
    "pounds",
    "meters",
    "meals",
    "edges",
    "students",
    "childrentickets",
    "multiples",
    "\\text{s}",
    "\\text{.}",
    "\\text{\ns}",
    "\\text{}^2",
    "\\text{}^3",
    "\\text{\n}",
    "\\text{}",
    "\\mathrm{th}",
    "^\\circ",
    "^{\\circ}",
    "\\;",
    ",\\!",
    "{,}",
    '"',
    "\\dots",
]
# Lines that only tell a speaker to begin with its name.
NAME_INSTRUCTIONS = [
    r'^\s*\d+\.\s*You must begin your response with ["\\]*\$\{name\}:["\\]*\.\s*$',
    r'^\s*\d+\.\s*You should start your utterance with ["\\]*\$\{name\}:["\\]*\.\s*$',
]
# Fixed value: the first number of an answer.
NUMBER = r"-?\d+(?:\.\d+)?"


def trimmed(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_tag(text: Column) -> Column:
    """The last <A>...</A answer, or null."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit("<A>(.*?)</A"), F.lit(1)), F.lit(-1))


def normalize_answer(text: Column) -> Column:
    """A quantitative answer in normal form: units, wrappers and shorthand TeX taken away."""
    out = F.element_at(F.split(text, "="), -1)
    for before, after in SUBSTITUTIONS + [(x, "") for x in REMOVED_EXPRESSIONS]:
        out = F.replace(out, F.lit(before), F.lit(after))
    # Patterns and what stays of them, in this order.
    for pattern, kept in [
        (r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"),
        (r"(\\text\{)(.*?)(\})", "$2"),
        (r"(\\textbf\{)(.*?)(\})", "$2"),
        (r"(\\overline\{)(.*?)(\})", "$2"),
        (r"(\\boxed\{)(.*)(\})", "$2"),
        (r"(frac)([^{])(.)", "frac{$2}{$3}"),
        (r"(sqrt)([^{])", "sqrt{$2}"),
    ]:
        out = F.regexp_replace(out, pattern, kept)
    out = F.replace(out, F.lit("$"), F.lit(""))
    plain = F.replace(out, F.lit(","), F.lit(""))
    return F.when(plain.rlike(r"^\d+$"), plain).otherwise(out)


def first_number(text: Column) -> Column:
    """The first number, or the text itself if there is none."""
    return F.coalesce(F.get(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), F.lit(0)), text)


def exact_gold(text: Column) -> Column:
    return F.lower(trimmed(text))


def exact_prediction(text: Column) -> Column:
    """As a gold answer, but without backslashes at its ends."""
    return F.lower(F.btrim(trimmed(text), F.lit("\\")))


def exact_report(text: Column) -> Column:
    """The normaliser of reports: null is empty, both sides lose backslashes."""
    return exact_prediction(F.coalesce(text, F.lit("")))


def f1_text(text: Column) -> Column:
    """The normaliser of token F1; it strips sets of characters, so that "amsterdam" loses its m."""
    return F.btrim(F.btrim(trimmed(F.lower(text)), F.lit("m=")), F.lit("m ="))


def tokens(text: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


#: What makes an array of tokens of a text; a column function, or the call of a user's own Arrow function.
Tokenizer = Callable[[Column], Column]


def token_count(text: Column, tokenizer: Tokenizer = tokens) -> Column:
    return F.size(tokenizer(text))


def strip_speaker(text: Column) -> Column:
    """An utterance without its speaker's name, for comparison."""
    return F.lower(trimmed(F.regexp_replace(text, r"^\s*(Alice|Bob)\s*:\s*", "")))


def strip_speaker_bold(text: Column) -> Column:
    """As strip_speaker, also after asterisks, and keeping capitals; null is empty."""
    return trimmed(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s*\**\s*(Alice|Bob)\s*:\s*", ""))


def strip_speaker_legacy(text: Column) -> Column:
    """The older rule, which strips sets of characters rather than prefixes."""
    return F.btrim(F.btrim(text, F.lit("Alice:")), F.lit("Bob:"))


def add_speaker(content: Column, speaker: Column, data_type: Column) -> Column:
    """Put the speaker in front of turns that lack it, other than in question answering."""
    return F.when((data_type != "qa") & ~F.startswith(trimmed(content), speaker), F.concat(speaker, F.lit(":"), content)).otherwise(content)


def drop_name_instruction(text: Column) -> Column:
    """Without the lines that only ask for a speaker's name in front."""
    lines = F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n")
    told = lambda line: reduce(Column.__or__, [line.rlike(p) for p in NAME_INSTRUCTIONS])
    return F.array_join(F.filter(lines, lambda line: ~told(line)), "\n")


def fill_template(template: Column, **values: Column) -> Column:
    """Replace ${name} by values; unknown names stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit("${" + name + "}"), value)
    return template


def trim_at(text: Column, markers: list[str]) -> Column:
    """The text before the first of some markers, without white space at its end; whole if there is none."""
    at = F.least(*[F.nullif(F.instr(text, m), F.lit(0)) for m in markers], F.lit(None).cast("int"))
    return F.when(at.isNull(), text).otherwise(F.regexp_replace(F.substring(text, F.lit(1), at - 1), r"\s+$", ""))


def single_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def docstring(code: Column) -> Column:
    """The docstring of a function: between triple double quotes (the second pair of four marks), else single ones; null otherwise."""
    double, single = F.split(code, '"""'), F.split(code, "'''")
    return F.when(F.size(double) == 3, trimmed(F.get(double, F.lit(1)))).when(F.size(double) == 5, trimmed(F.get(double, F.lit(3)))).when(F.size(single) == 3, trimmed(F.get(single, F.lit(1))))


def is_mojibake(text: Column) -> Column:
    return text.rlike(r"[\x{0}-\x{8}\x{FFFD}]")


def prompt_body(prompt: Column) -> Column:
    """The text of the first <p> element."""
    return F.regexp_extract(prompt, "(?s)<p>(.*?)</p>", 1)


def edit_share(a: Column, b: Column) -> Column:
    """Edit distance over the longer length plus one."""
    return F.levenshtein(a, b) / (F.greatest(F.length(a), F.length(b)) + 1)


def edit_share_new(old: Column, new: Column) -> Column:
    """Edit distance over the new text's length plus one."""
    return F.levenshtein(old, new) / (F.length(new) + 1)


def shared_count(a: Column, b: Column) -> Column:
    """The size of the intersection of two multisets: one walk through both, sorted together."""
    of = lambda items, side: F.transform(items, lambda t: F.struct(t.alias("t"), F.lit(side).alias("side")))
    start = F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).alias("a"), F.lit(0).alias("both"))

    def step(held: Column, x: Column) -> Column:
        # The first side's items of a token come before the second's, which use them up.
        same = held["t"].eqNullSafe(x["t"])
        left = F.when(same, held["a"]).otherwise(F.lit(0))
        used = (x["side"] == 1) & (left > 0)
        return F.struct(x["t"].alias("t"), F.when(x["side"] == 0, left + 1).when(used, left - 1).otherwise(left).alias("a"), F.when(used, held["both"] + 1).otherwise(held["both"]).alias("both"))

    return F.aggregate(F.sort_array(F.concat(of(a, 0), of(b, 1))), start, step, lambda held: held["both"])


def token_f1(gold: Column, predicted: Column, tokenizer: Tokenizer = tokens) -> Column:
    """F1 of the multisets of tokens of two normalised texts; null counts as no match."""
    pair = F.array(F.struct(tokenizer(f1_text(gold)).alias("a"), tokenizer(f1_text(predicted)).alias("b")))
    counted = F.transform(pair, lambda p: F.struct(F.size(p["a"]).alias("n"), F.size(p["b"]).alias("m"), shared_count(p["a"], p["b"]).alias("both")))

    def score(c: Column) -> Column:
        precision, recall = c["both"] / F.greatest(c["m"], F.lit(1)), c["both"] / F.greatest(c["n"], F.lit(1))
        return F.when(c["both"] > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))

    return F.get(F.transform(counted, score), F.lit(0))


def alternating_count(conversation: Column, tokenizers: tuple[Tokenizer, ...] = (tokens, tokens)) -> Column:
    """Tokens of a conversation whose sentences take turns between tokenizers."""
    sizes = F.transform(conversation, lambda s, k: F.element_at(F.array(*[F.size(t(s)) for t in tokenizers]), (k % len(tokenizers) + 1).cast("int")))
    return F.aggregate(sizes, F.lit(0), lambda n, x: n + x)


def common_words(a: list[str], b: list[str]) -> set[str]:
    """The words of a longest common subsequence: that which is read off the table from its end, going back in b where both ways are as long."""
    rows = [[0] * (len(b) + 1)]
    for x in a:
        row, above = [0], rows[-1]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
        rows.append(row)
    found, i, j = set(), len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            found.add(a[i - 1])
            i, j = i - 1, j - 1
        elif rows[i - 1][j] > rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return found


def sentences(text: str) -> list[list[str]]:
    """The words of the parts between full stops; a part of white space only is one empty word."""
    return [" ".join(x.split()).split(" ") for x in text.split(".") if x]


def summary_rouge_l(gold: str | None, predicted: str | None) -> float:
    """F of the union of longest common subsequences of all pairs of sentences, over the distinct words of either text."""
    g, p = sentences(gold or ""), sentences("UNKNOW" if predicted in (None, "", "...") else predicted)
    if not g or not p:
        return 0.0
    union = {w for y in p for x in g for w in common_words(y, x)}
    precision, recall = len(union) / len({w for x in g for w in x}), len(union) / len({w for y in p for w in y})
    return 2 * precision * recall / (precision + recall + 1e-8)


def rouge_l(gold: Column, predicted: Column) -> Column:
    """The oldest correctness score: ROUGE-L of whole texts (``summary_rouge_l``); an empty answer or "..." counts as one unknown word."""
    from turnmill.shipping import ship

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([summary_rouge_l(g, p) for g, p in zip(x, y, strict=True)], dtype="float64")

    ship()
    return score(gold, predicted)
