"""Reviewer signals to feedback types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from revsieve.functions.text import any_of

# Reactions that count for or against a finding; others are neutral.
REACTION_TYPES = {
    "+1": "positive",
    "thumbs_up": "positive",
    "-1": "negative",
    "thumbs_down": "negative",
    "heart": "positive",
    "hooray": "positive",
}
# Reply words, tested group by group in this order.
REPLY_WORDS = (
    ("positive", ("thanks", "good", "helpful", "correct", "agree")),
    ("negative", ("wrong", "incorrect", "not", "disagree", "false")),
    ("correction", ("actually", "should be", "better", "instead")),
)


def reaction_type(reaction: Column) -> Column:
    pairs = [F.lit(x) for kv in REACTION_TYPES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(reaction)), F.lit("neutral"))


def reply_type(text: Column, whole_words: bool = False) -> Column:
    """First word group that occurs in the reply.

    Words are found anywhere in the text, so "incorrect" counts as positive;
    ``whole_words`` asks for words of their own instead.
    """
    low = F.lower(text)

    def hit(words):
        if whole_words:
            return low.rlike(r"\b(?:" + "|".join(words) + r")\b")
        return any_of(low, words)

    first, *others = REPLY_WORDS
    start = F.when(hit(first[1]), first[0])
    return reduce(lambda acc, g: acc.when(hit(g[1]), g[0]), others, start).otherwise("neutral")


def reply_correction(text: Column, kind: Column) -> Column:
    return F.when(kind == "correction", text)


def fixed_type(was_fixed: Column) -> Column:
    return F.when(was_fixed, "positive").otherwise("negative")
