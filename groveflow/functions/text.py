"""Text column expressions: answer extraction, normalisation, offsets, identifiers."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use) -> Column:
    """`use(value)` with the value evaluated once, however often `use` refers to it: a Column is a tree, and each reference
    would be evaluated anew."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def last_match(text: Column, pattern: str, group: int = 0) -> Column:
    """Last match of a pattern or null."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.try_element_at(found, F.lit(-1))


def last_number(text: Column) -> Column:
    """Last number in a text, thousands commas removed."""
    return last_match(F.replace(text, F.lit(","), F.lit("")), r"-?\d+\.?\d*")


def delimited_number(text: Column) -> Column:
    """Number after the last #### within the final 300 characters, commas and dollar signs removed."""
    return F.regexp_replace(last_match(F.right(text, F.lit(300)), r"#### (\-?[0-9\.\,]+)", 1), "[,$]", "")


def last_boxed(text: Column) -> Column:
    r"""Content of the last \boxed{...} that closes. Braces are counted over the brace positions of each piece that follows
    a `boxed{`, so nesting may have any depth and texts any length; a closing brace before % keeps its brace."""

    def content(piece):
        runs = F.regexp_extract_all(piece, F.lit(r"[^{}]*+[{}]"), F.lit(0))
        zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("end"))

        def step(acc, run):
            def moved(depth):
                at = acc["at"] + F.length(run)
                return F.struct(depth.alias("depth"), at.alias("at"), F.when((acc["end"] < 0) & (depth < 0), at - 1).otherwise(acc["end"]).alias("end"))

            return bind(acc["depth"] + F.when(run.endswith("{"), 1).otherwise(-1), moved)

        def cut(end):
            size = F.when(piece.substr(end + 2, F.lit(1)) == "%", end + 1).otherwise(end)
            return F.when(end >= 0, piece.substr(F.lit(1), size))

        return bind(F.aggregate(runs, zero, step, lambda acc: acc["end"]), cut)

    def last(text):
        pieces = bind(F.split(text, r"boxed\{"), lambda p: F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))))
        closed = F.filter(F.transform(pieces, content), lambda x: x.isNotNull())
        return F.when(F.contains(text, F.lit("boxed{")), F.try_element_at(closed, F.lit(-1)))

    return bind(text, last)


# Plain-text replacements and removals of the answer normalisation, in order.
REPLACED = [
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
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points",
    "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students",
    "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}",
    "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]


def answer_line(text: Column) -> Column:
    """Last `Answer: ...` line, or [INVALID]."""
    return F.coalesce(last_match(text, r"(?i)Answer\s*:\s*([^\n]+)", 1), F.lit("[INVALID]"))


def normal_answer(text: Column) -> Column:
    """Normal form of a final answer: units and filler removed, LaTeX shorthand expanded."""
    x = F.element_at(F.split(text, "="), -1)
    for old, new in REPLACED + [(r, "") for r in REMOVED]:
        x = F.replace(x, F.lit(old), F.lit(new))
    # fixed values, in order
    for pattern, new in [
        (r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"),
        (r"\\text\{(.*?)\}", "$1"),
        (r"\\textbf\{(.*?)\}", "$1"),
        (r"\\overline\{(.*?)\}", "$1"),
        (r"\\boxed\{(.*)\}", "$1"),
        (r"frac([^{])(.)", r"frac{$1}{$2}"),
        (r"sqrt([^{])", r"sqrt{$1}"),
    ]:
        x = F.regexp_replace(x, pattern, new)
    x = F.replace(x, F.lit("$"), F.lit(""))
    number = lambda x: bind(F.replace(x, F.lit(","), F.lit("")), lambda digits: F.when(digits.rlike(r"^\d+$"), digits).otherwise(x))
    return strip(bind(x, number))


def latex_normal(text: Column) -> Column:
    """Normal form of a LaTeX string: fractions, roots, units, degrees, leading dots, spaces."""
    x = strip(text)
    outer = r"^\\text\{(.+?)\}$"
    x = bind(x, lambda x: F.when(x.rlike(outer), strip(F.regexp_extract(x, outer, 1))).otherwise(x))
    # fixed values, in order
    for old, new in [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""),
                     ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")]:
        x = F.replace(x, F.lit(old), F.lit(new))
    x = F.regexp_replace(x, r"\\text\{ .*$", "")
    x = F.replace(x, F.lit("\\%"), F.lit(""))
    x = F.regexp_replace(x, r"(^| |\{)\.", "$10.")
    # a short left-hand side (`k = `) is dropped
    side = lambda x: bind(F.split(x, "="), lambda p: F.when((F.size(p) == 2) & (F.length(F.element_at(p, 1)) <= 2), F.element_at(p, -1)).otherwise(x))
    x = bind(x, side)
    x = F.regexp_replace(x, r"sqrt([^{])", r"sqrt{$1}")
    x = F.replace(x, F.lit(" "), F.lit(""))
    x = F.regexp_replace(x, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    x = F.regexp_replace(x, r"\\frac([^{])(\{)", r"\\frac{$1}$2")
    x = bind(x, lambda x: F.when(x == "0.5", F.lit("\\frac{1}{2}")).otherwise(x))
    return F.regexp_replace(x, r"^(-?\d+)/(-?\d+)$", r"\\frac{$1}{$2}")


def qa_normal(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no English articles, single spaces."""
    x = F.regexp_replace(F.lower(text), r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]""", "")
    x = F.regexp_replace(x, r"(?U)\b(a|an|the)\b", " ")
    return strip(F.regexp_replace(x, r"\s+", " "))


def answer_tag(text: Column) -> Column:
    """Content of the last <answer> tag, trimmed; null without one."""
    return strip(last_match(text, r"(?s)<answer>(.*?)</answer>", 1))


def count_of(text: Column, needle: str) -> Column:
    """Occurrences of a plain string."""
    return (F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / F.lit(len(needle))


def boxed_or_delimited(prompt: Column, text: Column) -> Column:
    """Parse mode from the prompt: with `# answer` in it (any case) the text must hold `# Answer` and a line end exactly once
    and what follows is the answer; otherwise the last boxed content in its normal form. Empty answers are null."""
    parts = F.split(text, "# Answer\n")
    by_mark = F.when(F.size(parts) == 2, strip(F.element_at(parts, 2)))
    found = F.when(F.contains(F.lower(prompt), F.lit("# answer")), by_mark).otherwise(latex_normal(last_boxed(text)))
    return F.nullif(found, F.lit(""))


def step_offsets(text: Column, delimiter: str = "\n", answer_mark: str = "####") -> Column:
    """Start offsets of the steps of a solution plus its length. Steps end before a delimiter; leading blank
    steps belong to the first real one, and what follows the last real step belongs to it when an answer part
    (after `answer_mark`) exists."""
    parts = F.split(text, answer_mark)
    has_answer = F.size(parts) == 2
    body = F.when(has_answer, F.element_at(parts, 1)).otherwise(text)
    steps = F.split(body, delimiter)
    ends = F.slice(
        F.aggregate(steps, F.array(F.lit(-len(delimiter))), lambda acc, s: F.array_append(acc, F.element_at(acc, -1) + F.length(s) + len(delimiter))),
        2, F.size(steps) - 1,
    )
    real = F.transform(steps, lambda s, i: F.when(s.rlike(r"\S"), i))
    known = F.filter(real, lambda i: i.isNotNull())
    first, last = F.coalesce(F.array_min(known), F.lit(0)), F.coalesce(F.array_max(known), F.lit(0))
    cuts = F.transform(ends, lambda e, i: F.when((i >= first) & (~has_answer | (i < last)), e))
    return F.concat(F.array(F.lit(0)), F.filter(cuts, lambda e: e.isNotNull()), F.array(F.length(text)))


def strip_calculator(text: Column) -> Column:
    """Remove <<...>> calculator annotations."""
    return F.regexp_replace(text, r"(?s)<<.*?>>", "")


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def first_line(text: Column) -> Column:
    return F.element_at(F.split(strip(text), "\n"), 1)


def clean_completion(text: Column) -> Column:
    """Sentence-completion clean-up: titles and bracketed marks go, double spaces collapse once."""
    x = F.replace(strip(text), F.lit(" [title]"), F.lit(". "))
    x = F.regexp_replace(x, r"\[.*?\]", "")
    return F.replace(x, F.lit("  "), F.lit(" "))


def parse_tree_id(ident: Column) -> list[Column]:
    """`{snapshot}|iter:{n}|q:{question}|{tiebreak}` to its three parts; null where the form differs."""
    form = r"^(.*)\|iter:(-?\d+)\|q:(.*)\|[^|]*$"
    part = lambda g: F.when(ident.rlike(form), F.regexp_extract(ident, form, g))
    return [part(1).alias("snapshot"), part(2).try_cast("bigint").alias("iteration"), part(3).alias("question")]


def spans(text: Column, marks: list[str]) -> Column:
    """Split a text before each mark: segments (type, content) for marks and the text between them."""
    alt = "|".join(marks)
    parts = F.filter(F.split(text, f"(?={alt})|(?<={alt})"), lambda p: p != "")
    kind = lambda p: reduce(lambda acc, m: F.when(p == m, m.strip("<>")).otherwise(acc), marks, F.lit("text"))
    return F.transform(parts, lambda p: F.struct(kind(p).alias("type"), p.alias("content")))
