"""Lexicon sentiment inside one row: no explode, no join, no shuffle."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens import fixed_values as fixed
from postlens.functions.lists import bind
from postlens.functions.text import words


def lexicon_lookup(lexicon: dict[str, float]):
    """Token → valence as set membership tests, one hash set per distinct valence, in one flat expression."""
    groups = defaultdict(list)
    for token, valence in lexicon.items():
        groups[float(valence)].append(token)

    def lookup(token: Column) -> Column:
        if not groups:
            return F.lit(None).cast("double")
        value = F
        for valence, members in groups.items():
            value = value.when(token.isin(*members), valence)
        return F.when(token.isin(*lexicon), value)

    return lookup


def compound(total: Column) -> Column:
    """Map a valence sum to [-1, 1]."""
    return F.round(total / F.sqrt(total * total + fixed.NORMALISER), 4)


def lexicon_sentiment(text: Column, lexicon: dict[str, float]) -> Column:
    """Plain lexicon score: the sum of word valences, normalised."""
    lookup = lexicon_lookup(lexicon)
    valences = F.transform(words(F.lower(text)), lookup)
    total = F.aggregate(valences, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))
    return bind(total, compound)


def _is_capital(word: Column) -> Column:
    return (F.upper(word) == word) & (F.lower(word) != word)


def _booster(low: Column) -> Column:
    return F.when(low.isin(*fixed.AMPLIFIERS), fixed.BOOST).when(low.isin(*fixed.DAMPENERS), -fixed.BOOST)


def rule_total(spoken: Column) -> Column:
    """Valence sum after boosters, negation, capitals and the word "but".

    ``spoken`` has the words of a text, their lower forms and their valences (null outside the lexicon).
    Only words with a valence, and the three before each, are looked at any further.
    """

    def score(text: Column) -> Column:
        said, low, valences = text["words"], text["low"], text["valences"]
        # Capitals count only in a text that is not all capitals; looked up when a capital word asks for it.
        mixed = F.exists(said, _is_capital) & F.exists(said, lambda w: ~_is_capital(w))

        def shout(word: Column, sign: Column) -> Column:
            return F.when(_is_capital(word) & mixed, sign * fixed.CAPITALS_BOOST).otherwise(0.0)

        def up(value: Column) -> Column:
            return F.when(value > 0, 1.0).otherwise(-1.0)

        def adjusted(pos: Column) -> Column:
            own = bind(F.get(valences, pos), lambda v: v + shout(F.get(said, pos), up(v)))

            def look_back(value: Column, distance: Column) -> Column:
                before = F.get(low, pos - distance)

                def apply(step: Column) -> Column:
                    boost = F.when(
                        step.isNotNull(),
                        step * F.when(value < 0, -1.0).otherwise(1.0)
                        + shout(F.get(said, pos - distance), up(value)),
                    ).otherwise(0.0)
                    decay = F.get(F.array(*[F.lit(d) for d in fixed.BOOST_DECAY]), distance - 1)
                    factor = F.when(before.isin(*fixed.NEGATIONS), fixed.NEGATION_FACTOR).otherwise(1.0)
                    return (value + boost * decay) * factor

                skip = before.isNull() | F.get(valences, pos - distance).isNotNull()
                return F.when(skip, value).otherwise(bind(_booster(before), apply))

            final = F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), own, look_back)

            def weight(but: Column) -> Column:
                return (
                    F.when((but == 0) | (pos + 1 == but), 1.0)
                    .when(pos + 1 < but, fixed.BEFORE_BUT)
                    .otherwise(fixed.AFTER_BUT)
                )

            return final * bind(F.array_position(low, "but").cast("int"), weight)

        valued = F.filter(
            F.transform(valences, lambda v, i: F.when(v.isNotNull(), i)),
            lambda i: i.isNotNull() & _booster(F.get(low, i)).isNull(),
        )
        return F.aggregate(F.transform(valued, adjusted), F.lit(0.0), lambda a, v: a + v)

    return bind(spoken, score)


def spoken_words(said: Column, valences: Column | None = None, lookup=None) -> Column:
    """Words, lower forms and valences; the valences are looked up unless they are given."""

    def with_values(both: Column) -> Column:
        values = F.transform(both["low"], lookup) if valences is None else valences
        return F.struct(both["words"].alias("words"), both["low"].alias("low"), values.alias("valences"))

    return bind(said, lambda w: bind(F.struct(w.alias("words"), F.transform(w, F.lower).alias("low")), with_values))


def emphasis(text: Column) -> Column:
    """Extra weight of exclamation and question marks."""
    marks = F.least(F.regexp_count(text, F.lit("!")), F.lit(fixed.EXCLAMATION_CAP)) * fixed.EXCLAMATION_BOOST
    asked = F.regexp_count(text, F.lit(r"\?"))
    return marks + F.when(asked <= 1, 0.0).when(asked <= 3, asked * fixed.QUESTION_BOOST).otherwise(
        fixed.QUESTION_CAP_SCORE
    )


def rule_compound(text: Column, spoken: Column) -> Column:
    def finish(b: Column) -> Column:
        signed = F.when(b["total"] > 0, b["extra"]).when(b["total"] < 0, -b["extra"]).otherwise(0.0)
        return bind(b["total"] + signed, compound)

    return bind(F.struct(rule_total(spoken).alias("total"), emphasis(text).alias("extra")), finish)


def rule_sentiment(text: Column, lexicon: dict[str, float]) -> Column:
    """Rule-based score with a lexicon small enough to be part of the expression."""
    return rule_compound(text, spoken_words(words(text), lookup=lexicon_lookup(lexicon)))
