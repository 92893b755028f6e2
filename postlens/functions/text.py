"""Scalar text, number and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens import fixed_values as fixed
from postlens.functions.lists import bind, first_of_each, or_empty

_LETTERS = fixed.TURKISH_LETTERS
_TOKEN_CLASS = "0-9A-Za-z" + _LETTERS + fixed.TOKEN_PUNCTUATION.replace("-", "\\-")
_QUOTED = "\"[^\"]*\"|'[^']*'"
#: A word with inner apostrophes ("can't") counts as one.
WORD = r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*"


# --- normalising -------------------------------------------------------------------------------------

def clean_text(text: Column) -> Column:
    """One line, single spaces, trimmed; null becomes empty. Covers Unicode and separator whitespace."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def fold(text: Column) -> Column:
    """Lower case plus the foldings that matter for matching (sharp s, final sigma, long s)."""
    return F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "ςſ", "σs")


def ascii_form(text: Column) -> Column:
    return F.translate(text, fixed.TURKISH_LETTERS, fixed.TURKISH_ASCII)


def ascii_only(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[^\x00-\x7F]+", ""))


def prompt_norm(text: Column) -> Column:
    """Lower case, only a-z, 0-9 and whitespace, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", " "))


def prompt_words(text: Column) -> Column:
    return F.regexp_extract_all(prompt_norm(text), F.lit(r"\S+"), F.lit(0))


def lookup_key(term: Column) -> Column:
    cleaned = F.regexp_replace(F.coalesce(term, F.lit("")), f"[^{_TOKEN_CLASS}]", " ")
    return ascii_form(fold(F.trim(cleaned)))


def community_tag(name: Column) -> Column:
    """``r/`` plus the last path segment."""
    return F.concat(F.lit("r/"), F.element_at(F.split(name, "/"), -1))


def seed_community_tag(name: Column) -> Column:
    """Like :func:`community_tag`, but a name that already has the prefix is left as it is."""
    trimmed = F.trim(name)
    return F.when(F.lower(trimmed).startswith("r/"), trimmed).otherwise(community_tag(trimmed))


# --- tests -------------------------------------------------------------------------------------------

def is_english(text: Column) -> Column:
    """More than 70 % of the letters are ASCII; a text without letters passes."""
    ascii_letters = F.length(F.regexp_replace(text, "[^A-Za-z]+", ""))
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    return F.coalesce(F.try_divide(ascii_letters, letters) > fixed.ENGLISH_SHARE, F.lit(True))


def has_non_ascii(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"[^\x00-\x7F]")


# --- post fields -------------------------------------------------------------------------------------

def permalink(full_link: Column, community: Column, post_id: Column, site=fixed.PERMALINK_SITE) -> Column:
    name = F.replace(F.coalesce(community, F.lit("")), F.lit("r/"), F.lit(""))
    tail = F.concat(F.lit("/comments/"), F.coalesce(post_id, F.lit("")), F.lit("/"))
    built = F.when(name != "", F.concat(F.lit(site + "/r/"), name, tail)).otherwise(
        F.concat(F.lit(site), tail)
    )
    return F.coalesce(F.nullif(full_link, F.lit("")), built)


def analysis_text(title: Column, selftext: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(selftext, F.lit("")))


def match_text(title: Column, selftext: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(selftext, F.lit("")))


def whole_number(value: Column) -> Column:
    """Lenient integer: fractions are cut off, anything unusable is 0."""
    number = F.nanvl(value.try_cast("double"), F.lit(0.0))
    return F.coalesce(number.try_cast("int"), F.lit(0))


def pain_score(sentiment: Column, upvotes: Column, comments: Column) -> Column:
    """Negative sentiment weighted by engagement, three places."""
    engagement = F.greatest(upvotes.cast("long") + comments.cast("long"), F.lit(0))
    return F.round(F.greatest(F.lit(0.0), -sentiment) * (1 + F.log1p(engagement)), 3)


def complaints(text: Column, limit: int = 5) -> Column:
    """The first complaint phrases of a text, in pattern order, then position."""
    found = bind(
        F.lower(text),
        lambda low: F.concat(
            *[F.regexp_extract_all(low, F.lit(p), F.lit(0)) for p in fixed.COMPLAINT_PATTERNS]
        ),
    )
    return F.transform(F.slice(found, 1, limit), lambda phrase: F.trim(phrase))


def two_places(value: Column) -> Column:
    """Two decimals, half-even on the exact binary value; a format string would round 0.125 up."""
    return F.call_function("format_number", value, F.lit("0.00"))


def window_start(as_of: Column, months: Column) -> Column:
    """Start of the time window in epoch seconds; a month is 30 days, at least one."""
    return as_of - F.greatest(F.lit(1), months).cast("long") * fixed.SECONDS_PER_MONTH


# --- tokens and terms --------------------------------------------------------------------------------

def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def has_quotes(text: Column) -> Column:
    """Whether quoting applies. Without quotes it has nothing to do; unbalanced quotes turn it off."""
    return text.rlike("[\"']") & ~F.regexp_replace(text, _QUOTED, "").rlike("[\"']")


def quoted_parts(text: Column) -> Column:
    """Whitespace-separated parts, quoted stretches kept together and their quotes removed."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(f"(?:[^\\s\"']+|{_QUOTED})+"), F.lit(0)),
        lambda part: F.when(
            part.rlike("[\"']"), F.regexp_replace(part, "\"([^\"]*)\"|'([^']*)'", "$1$2")
        ).otherwise(part),
    )


def plain_parts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def shell_words(text: Column) -> Column:
    """Quote-aware split."""
    return F.when(has_quotes(text), quoted_parts(text)).otherwise(plain_parts(text))


def keyword_list(text: Column) -> Column:
    """A keyword argument as a list: quote-aware, trimmed, no blanks, first spelling kept."""
    parts = F.transform(shell_words(F.coalesce(text, F.lit(""))), lambda p: F.trim(p))
    return first_of_each(F.filter(parts, lambda p: p != ""), F.lower)


def token_chunks(text: Column) -> Column:
    """Stretches of token characters, folded (for these characters lower case is all there is to it)."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"[{_TOKEN_CLASS}]+"), F.lit(0)), F.lower)


def list_tokens(parts: Column) -> Column:
    """Tokens of a keyword list; an element with a space stays one phrase, others split at dropped characters."""

    def part_tokens(part: Column) -> Column:
        return F.when(part.contains(" "), F.array(F.array_join(token_chunks(part), " "))).otherwise(
            token_chunks(part)
        )

    return F.filter(F.flatten(F.transform(or_empty(parts), part_tokens)), lambda x: x != "")


def tokens(text: Column) -> Column:
    """Search tokens of a text; a quoted phrase is one token. Text without quoting is split in one go."""
    text = F.coalesce(text, F.lit(""))
    return F.when(has_quotes(text), list_tokens(quoted_parts(text))).otherwise(token_chunks(text))


def drop_stop_words(items: Column, stop_words=fixed.STOP_WORDS, min_length: int = 3) -> Column:
    return F.filter(items, lambda t: (F.length(t) >= min_length) & ~t.isin(*stop_words))


def stems(key: Column, suffixes=fixed.SUFFIXES) -> Column:
    """What remains of a lookup key after one suffix, longest stem first."""
    ordered = sorted(dict.fromkeys(suffixes), key=len)

    def cut(key: Column) -> Column:
        rest = [
            F.when(key.endswith(s) & (F.length(key) - len(s) >= 3), F.left(key, F.length(key) - F.lit(len(s))))
            for s in ordered
        ]
        return F.array_compact(F.array(*rest))

    return bind(key, cut)


def lookup_keys(term: Column, suffixes=fixed.SUFFIXES) -> Column:
    """The full lookup key, then its stems."""
    return bind(
        lookup_key(term),
        lambda key: F.filter(F.concat(F.array(key), stems(key, suffixes)), lambda k: k != ""),
    )


def starting_words(text: Column, groups: dict[str, list[str]], otherwise: str) -> Column:
    """The first group one of whose words occurs in the prompt."""

    def pick(found: Column) -> Column:
        out = F.lit(otherwise)
        for name, group in reversed(groups.items()):
            out = F.when(F.arrays_overlap(found, F.array(*[F.lit(w) for w in group])), name).otherwise(out)
        return out

    return bind(prompt_words(text), pick)
