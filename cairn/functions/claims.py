"""What texts claim: rules over generated messages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import card_rank
from .text import normalize

#: Phrases by which a player says that nothing is played; each adds to a donor's clarity.
PASS_PHRASES = ["playing nothing", "play nothing", "pass", "passing", "shouldn't play anything", "should not play anything", "don't have any", "do not have any"]
#: Patterns of a claim to another offer, and the phrases that deny one.
OFFER_PATTERNS = ["\\banother (?:written )?offer\\b", "\\bother (?:written )?offer\\b", "\\bcompeting offer\\b", "\\bhigher offer\\b", "\\boffer elsewhere\\b", "\\boffer from\\b"]
OFFER_DENIALS = ["no other offer", "do not have another offer"]
#: A chat template's head, joints and tail in stored prompts, and what stands for them.
CHAT_PATTERNS = [
    ("(?s)^<\\|start\\|>system<\\|message\\|>.*?<\\|end\\|><\\|start\\|>developer<\\|message\\|>(# Instructions)?\\s*", ""),
    ("<\\|end\\|><\\|start\\|>(user|developer|system)<\\|message\\|>", "\n\n"),
    ("(?s)<\\|end\\|><\\|start\\|>assistant.*$", ""),
]
#: Chat control tokens in stored prompts and what stands for them.
CHAT_TOKENS = [("<｜begin▁of▁sentence｜>", ""), ("<｜Assistant｜><think>\n", ""), ("<｜Assistant｜>", ""), ("<think>", ""), ("<｜User｜>", "\n\n"), ("<|im_start|>", ""), ("<|im_end|>", "")]
#: Traces of templates and answers in text that cannot serve as a donor's reasoning.
TEMPLATE_MARKS = ["<|start|>", "<|end|>", "{", "}"]
ANSWER_MARKS = ["assistantanalysis", "assistantfinal", "assistantcommentary", "developer#", "systemyou are chatgpt", "usergame history", "cards_played", '"action"', "action:", "respond in json"]
#: Where a generation ends and another message of the chat begins.
MESSAGE_STARTS = ["<|start|>", "assistantanalysis", "assistantfinal", "assistantcommentary", "\nsystem", "\ndeveloper", "\nuser"]


def any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def claims_other_offer(message: Column) -> Column:
    """Whether a message claims another offer and does not deny one."""
    said = F.lower(F.trim(F.coalesce(message, F.lit(""))))
    return any_of([said.rlike(p) for p in OFFER_PATTERNS]) & ~any_of([said.contains(p) for p in OFFER_DENIALS])


def mentions_number(message: Column, number: Column) -> Column:
    """Whether the number stands in the text, plain or with thousands commas (a dollar sign before it changes nothing)."""
    plain, grouped = number.cast("long").cast("string"), F.format_number(number.cast("long"), 0)
    return F.coalesce(message.contains(plain) | message.contains(grouped), F.lit(False))


def donor_clarity(first_sentence: Column, rank: Column, cards: Column) -> Column:
    """How clearly a sentence says what a true play would be; -infinity for an empty one.

    Short texts, the required rank, saying that there is none of it, phrases of passing, and cards that are all of the
    rank add to it; each character beyond 80 takes a little away.
    """
    said = F.coalesce(normalize(first_sentence), F.lit(""))
    name = rank.cast("string")
    length = -0.0025 * F.greatest(F.length(said) - 80, F.lit(0)) + F.when(F.length(said) <= 160, 0.4).otherwise(0.0)
    named = F.when(F.regexp_like(said, F.concat(F.lit("\\b"), name, F.lit("s?\\b"))), 1.25).otherwise(0.0)
    none_of_it = any_of([said.contains(F.concat(F.lit(p), name, F.lit(s))) for p, s in (("don't have any ", ""), ("do not have any ", ""), ("no ", "s"))])
    passing = sum((F.when(said.contains(p), 0.75).otherwise(0.0) for p in PASS_PHRASES), F.lit(0.0))
    played = F.filter(F.transform(F.coalesce(cards, F.array().cast("array<string>")), F.trim), lambda c: c != "")
    ranks = F.filter(F.transform(played, lambda c: card_rank(c)), lambda r: r.isNotNull())
    fitting = F.when(rank.isNotNull() & F.forall(ranks, lambda r: r == rank), 1.0).otherwise(0.0)
    hand = F.when(F.size(played) == 0, 0.35).otherwise(0.15 * F.least(F.size(played), F.lit(4)) + fitting)
    by_rank = F.when(rank.isNotNull(), named + F.when(none_of_it, 1.5).otherwise(0.0)).otherwise(0.0)
    return F.when(said == "", F.lit(float("-inf"))).otherwise(length + by_rank + passing + hand)


def clean_situation(prompt: Column) -> Column:
    """A stored prompt without the control tokens of its chat template."""
    out = prompt
    for pattern, instead in CHAT_PATTERNS:
        out = F.regexp_replace(out, pattern, instead)
    for token, instead in CHAT_TOKENS:
        out = F.replace(out, F.lit(token), F.lit(instead))
    return F.regexp_replace(out, "^\\s+|\\s+$", "")


def usable_reasoning(chunk: Column) -> Column:
    """Whether a chunk reads as reasoning: it has letters and no trace of JSON or of a template."""
    t = F.trim(F.coalesce(chunk, F.lit("")))
    marks = any_of([t.contains(m) for m in TEMPLATE_MARKS]) | any_of([F.lower(t).contains(m) for m in ANSWER_MARKS])
    return t.rlike("[A-Za-z]") & ~t.rlike("^[\\[{]") & ~marks


def own_generation(full: Column, prompt: Column, shared: Column) -> Column:
    """What a generation adds to the prompt and the shared context: without them, and up to the next message.

    A text that begins with either is taken as it goes on; otherwise what stands behind the first of them that occurs.
    """
    text, prompt, shared = (F.coalesce(c, F.lit("")) for c in (full, prompt, shared))
    known = [F.concat(prompt, shared), shared]
    behind = lambda k, at: F.ltrim(F.substring(text, at + F.length(k), F.length(text)))
    begins = [F.when((k != "") & F.startswith(text, k), behind(k, F.lit(1))) for k in known]
    occurs = [F.when((k != "") & (F.position(k, text) > 0), behind(k, F.position(k, text))) for k in known]
    rest = F.coalesce(*occurs, text)
    starts = F.array_min(F.filter(F.array(*[F.position(F.lit(m), F.lower(rest)) for m in MESSAGE_STARTS]), lambda p: p > 0))
    cut = F.when(starts.isNotNull(), F.substring(rest, F.lit(1), starts - 1)).otherwise(rest)
    return F.coalesce(*begins, F.regexp_replace(cut, "^\\s+|\\s+$", ""))
