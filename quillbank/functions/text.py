"""Text functions as Column expressions: normalisation, validation, style features, skeletons, URL hosts, verdicts.

Word boundaries are ASCII and spelt out, so that every engine agrees; lengths count code points. A null text gives null
unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists that define the features.
QUESTION_WORDS = ["what", "which", "how", "why", "when", "where", "who", "is", "are", "should", "can", "do", "does"]
CONSTRAINTS = ["under", "less than", "below", "over", "best", "vs", "versus", "than", "without", "with", "for", "near me", "cheap", "budget", "top", "compare", "difference", "between", "good", "affordable"]
FIRST_PERSON = ["i", "my", "me", "we", "our", "i'm", "i've"]
FUNCTION_WORDS = "the a an of to in on at and or but that this these those it its be been being was were am have has had will would could may might must shall not no so if then as by from about into over after before up down out off again also very too more most some any each such only own same just than".split()
KEPT_WORDS = FUNCTION_WORDS + "i my me we our you your what which how why when where who is are do does can should for with without under between vs there here need want looking best good please help".split()
POLITE = ["please", "thanks", "thank you", "could you", "can you", "would you", "help me"]
HEDGES = ["just", "really", "actually", "kind of", "sort of", "maybe", "probably", "basically", "honestly", "anyone", "any idea", "any ideas"]
CONJUNCTIONS = ["and", "or", "but", "so", "because"]
STOP_WORDS = "the a an of to in on at and or for with is are what which how do does can i my me should best good that this it be you your".split()
SEARCH_REJECT = r"(write|code|python|javascript|essay|poem|story|roleplay|pretend|as an? |translate|def |function |import |[^a-z0-9_]html[^a-z0-9_]|^html[^a-z0-9_]|[^a-z0-9_]html$|^html$|resume|cover letter|rewrite|paraphrase|correct my|fix this)"
SEARCH_REQUIRE = r"(what|which|how|why|when|where|best|vs|compare|should i|is it|are there|recommend|suggest|looking for|i need|difference|top [0-9]|good |better )"

# Classes of single characters: Java's patterns look these up in a bit set, while ranges are tried one after another.
SMALL, LARGE, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
WHITE = " \\t\\n\\x0B\\f\\r"
SPACE = f"[{WHITE}]+"
NO_WORD = f"[^{SMALL}{DIGITS}_]"


def words(text: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def has_word(text: Column, choices: list[str]) -> Column:
    """Whether lower-case ``text`` has one of the choices between ASCII word boundaries."""
    return text.rlike(f"(^|{NO_WORD})(" + "|".join(choices) + f")({NO_WORD}|$)")


def flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def in_list(word: Column, choices: list[str]) -> Column:
    return word.isin(*choices)


def dedup_key(text: Column) -> Column:
    """Lower case, only a-z, 0-9 and blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), f"[^{SMALL}{DIGITS} ]+", ""), " +", " "))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def is_prompt(text: Column, low: int = 12, high: int = 220) -> Column:
    """Length within bounds and no character above 126."""
    return F.length(text).between(low, high) & text.rlike("^[\\x00-\\x7E]*$")


def looks_like_search(text: Column) -> Column:
    low = F.lower(text)
    return ~low.rlike(SEARCH_REJECT) & low.rlike(SEARCH_REQUIRE) & F.size(F.split(low, " ")).between(3, 36)


def unquoted_first_line(text: Column) -> Column:
    """One quotation mark off either end, trimmed, the first line."""
    return F.split(F.trim(F.regexp_replace(F.regexp_replace(text, "^[\"']", ""), "[\"']$", "")), "\n")[0]


def fenced_json(text: Column) -> Column:
    """The text from the first bracket to the last one that closes, without a code fence; null if there is none."""
    return F.regexp_substr(F.regexp_replace(text, "```(json)?", ""), F.lit("(?s)[\\[{].*[\\]}]"))


def string_list(text: Column, low: int, high: int | None = None, most: int | None = None) -> Column:
    """The strings of a JSON array within the bounds (exclusive), trimmed; an unreadable text gives an empty list."""
    found = F.coalesce(F.from_json(fenced_json(text), "array<string>"), F.array().cast("array<string>"))
    kept = F.filter(found, lambda s: s.isNotNull() & (F.length(s) > low) & ((F.length(s) < high) if high else F.lit(True)))
    return F.transform(F.slice(kept, 1, most) if most else kept, lambda s: F.trim(s))


def style_features(text: Column, low: Column | None = None, w: Column | None = None) -> list[Column]:
    """Nine features of phrasing, named f1 to f9.

    ``low`` and ``w`` are the text in lower case and its words where a projection below has them already.
    """
    low = F.lower(text) if low is None else low
    w = words(low) if w is None else w
    count = F.size(w).cast("double")
    constraints = sum((flag(F.contains(low, F.lit(c))) for c in CONSTRAINTS), F.lit(0.0))
    parts = [
        count,
        F.length(text).cast("double"),
        flag(F.contains(text, F.lit("?"))),
        flag(has_word(low, FIRST_PERSON)),
        constraints,
        F.regexp_count(text, F.lit(f"[{DIGITS}]+")).cast("double"),
        F.regexp_count(F.concat(F.lit(" "), text), F.lit(f"[^{LARGE}{SMALL}{DIGITS}_][{LARGE}][{SMALL}]{{2,}}")).cast("double"),
        F.when(count > 0, F.aggregate(w, F.lit(0.0), lambda a, x: a + F.length(x)) / count).otherwise(0.0),
        flag((F.size(w) > 0) & F.coalesce(in_list(F.get(w, F.lit(0)), QUESTION_WORDS), F.lit(False))),
    ]
    return [p.alias(f"f{i}") for i, p in enumerate(parts, 1)]


#: Closing punctuation, and what stands for any other character beside a-z, 0-9, apostrophes and white space.
CLOSING, OTHER = "?.!,;:", "_"


def marked_words(text: Column) -> Column:
    """Lower-case words in which every other character is OTHER: one pattern over the text in place of some for each word."""
    return words(F.regexp_replace(F.lower(text), f"[^{SMALL}{DIGITS}'{CLOSING}{WHITE}]", OTHER))


def bare(word: Column) -> Column:
    """A marked word reduced to a-z, 0-9 and apostrophes."""
    return F.translate(word, OTHER + CLOSING, "")


def bare_words(text: Column) -> Column:
    """Lower-case words reduced to a-z, 0-9 and apostrophes; may hold empty strings."""
    return F.transform(marked_words(text), bare)


def style_features_2(text: Column) -> list[Column]:
    """Twelve features disjoint from ``style_features``, named g1 to g12."""
    low, tokens = F.lower(text), bare_words(text)
    count = F.greatest(F.size(tokens), F.lit(1)).cast("double")
    parts = [
        flag(text.rlike("^[a-z]")),
        flag(~F.trim(text).rlike("[.?!]$")),
        F.size(F.filter(tokens, lambda w: in_list(w, FUNCTION_WORDS))) / count,
        F.regexp_count(text, F.lit(",")) / count,
        flag(low.rlike("[a-z0-9_](n't|'s|'re|'ll|'d)([^a-z0-9_]|$)")),
        F.size(F.filter(F.split(text, "[.?!]+"), lambda x: F.trim(x) != "")).cast("double"),
        F.size(F.array_distinct(tokens)) / count,
        flag(has_word(low, POLITE)),
        flag(has_word(low, HEDGES)),
        flag(text.rlike('[;:()"]')),
        flag(has_word(low, ["you", "your"])),
        flag(has_word(low, CONJUNCTIONS)),
    ]
    return [p.cast("double").alias(f"g{i}") for i, p in enumerate(parts, 1)]


def skeleton(text: Column) -> Column:
    """Function words and closing punctuation; other words as X (runs collapsed), numbers as NUM; <s> and </s> around."""

    def parts(raw: Column) -> Column:
        word = bare(raw)
        shown = F.when(in_list(word, KEPT_WORDS), word).when(F.substring(word, 1, 1).between("0", "9"), "NUM").otherwise("X")
        mark = F.substring(raw, F.length(F.rtrim(raw, F.lit(CLOSING))) + 1, F.lit(1))
        return F.filter(F.array(F.when(word != "", shown), F.when(mark != "", mark)), lambda x: x.isNotNull())

    inner = F.flatten(F.transform(marked_words(text), parts))
    whole = F.concat(F.array(F.lit("<s>")), inner, F.array(F.lit("</s>")))
    # Binding by transform(array(x), ...) evaluates the list once.
    collapsed = F.transform(F.array(whole), lambda all_: F.filter(F.transform(all_, lambda x, i: F.when(~((x == "X") & (i > 0) & (F.get(all_, i - 1) == "X")), x)), lambda x: x.isNotNull()))
    return F.element_at(collapsed, 1)


def grams(tokens: Column) -> Column:
    """All tokens and all pairs of neighbours."""
    pairs = lambda all_: F.transform(all_, lambda t, i: F.concat(t, F.lit(" "), F.get(all_, i + 1)))
    both = F.transform(F.array(tokens), lambda all_: F.concat(all_, F.filter(pairs(all_), lambda p: p.isNotNull())))
    return F.element_at(both, 1)


def content_tokens(text: Column) -> Column:
    """The distinct words of a-z and 0-9 that are no stop words."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), f"[^{SMALL}{DIGITS}]", " "), " +"), lambda w: (w != "") & ~in_list(w, STOP_WORDS)))


def head_forms(text: Column) -> Column:
    """Words without stop words and without a closing s."""
    return F.transform(F.filter(words(F.lower(text)), lambda w: ~in_list(w, STOP_WORDS)), lambda w: F.regexp_replace(w, "s$", ""))


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def last_labels(url: Column, n: int = 2) -> Column:
    """The last ``n`` labels of the host without www; null for an unreadable URL."""
    labels = F.split(F.regexp_replace(host(url), "^www\\.", ""), "\\.")
    return F.concat_ws(".", F.when(F.size(labels) <= n, labels).otherwise(F.slice(labels, -n, n))) if n else labels


def registrable_domain(url: Column, suffixes: list[str]) -> Column:
    """One label before the longest of ``suffixes`` that the host ends in, else the last two labels."""
    h = host(url)
    found = F.coalesce(*[F.when(h.endswith("." + s), F.concat(F.element_at(F.split(F.substring(h, F.lit(1), F.length(h) - len(s) - 1), "\\."), -1), F.lit("." + s))) for s in sorted(suffixes, key=len, reverse=True)])
    return F.coalesce(found, last_labels(url, 2))


def percent_verdict(text: Column) -> Column:
    """The first integer of one to three digits, at most 100; null if there is none."""
    digits = F.regexp_extract(text, "([0-9]{1,3})", 1)
    return F.when(digits != "", F.least(F.lit(100), F.nullif(digits, F.lit("")).cast("int"))).cast("long")


def letter_verdict(text: Column) -> Column:
    first = F.upper(F.substring(F.trim(text), 1, 1))
    return F.when(first.isin("A", "B"), first)


def batch_verdict(text: Column, n: int) -> Column:
    """The numbers of a JSON array of exactly ``n``, else null."""
    found = F.from_json(fenced_json(text), "array<double>")
    return F.when(F.size(found) == n, found)


def coerced(value: Column, allowed: list[str], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def or_default(value: Column, default: Column) -> Column:
    """``default`` for null and for the empty string."""
    return F.coalesce(F.nullif(value, F.lit("")), default)


def escape_regex(text: Column) -> Column:
    return F.regexp_replace(text, "([.*+?^${}()|\\[\\]\\\\])", "\\\\$1")


def escape_latex(text: Column) -> Column:
    plain = F.translate(text, "‘’“”", "''\"\"")
    return F.regexp_replace(plain, "([&%$#_{}])", "\\\\$1")
