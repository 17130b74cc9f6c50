"""Coercions of raw JSON values (as strings) to typed columns. What cannot be read is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Literals of the tri-state label, by variant.
LABEL_TRUE = {"plain": ["1", "true", "t", "yes", "y", "deceptive"], "extended": ["1", "true", "t", "yes", "y", "deceptive"], "bool": ["1", "true", "t", "yes", "y"]}
LABEL_FALSE = {"plain": ["0", "false", "f", "no", "n", "truthful"], "extended": ["0", "false", "f", "no", "n", "truthful", "non-deceptive", "non_deceptive"], "bool": ["0", "false", "f", "no", "n"]}
DIRECTIONS = {"UP": ["U", "UP"], "DOWN": ["D", "DOWN"], "LEFT": ["L", "LEFT"], "RIGHT": ["R", "RIGHT"]}


def label(value: Column, variant: str = "plain") -> Column:
    """Tri-state label. The `bool` variant takes any whole number but 0 as true."""
    s = F.lower(F.trim(value.cast("string")))
    out = F.when(s.isin(LABEL_TRUE[variant]), True).when(s.isin(LABEL_FALSE[variant]), False)
    if variant == "bool":
        out = out.when(s.rlike("^[+-]?[0-9]+$"), s.cast("decimal(38,0)") != 0)
    return out.otherwise(F.lit(None).cast("boolean"))


def strict_bool(raw_json: Column) -> Column:
    """Only a JSON boolean counts."""
    return F.when(raw_json == "true", True).when(raw_json == "false", False)


def label_filter(keep: str, label_column: Column) -> Column:
    """all, deceptive_only or truthful_only; a NULL label is in neither of the latter."""
    if keep == "all":
        return F.lit(True)
    if keep not in ("deceptive_only", "truthful_only"):
        raise ValueError(f"unknown label filter: {keep}")
    return F.coalesce(label_column == F.lit(keep == "deceptive_only"), F.lit(False))


def resolve_filter(label_filter_: str | None, only_deceptive: bool = False, only_truthful: bool = False) -> str:
    """One filter of a name and two flags; flags that contradict raise."""
    flags = [n for n, on in (("deceptive_only", only_deceptive), ("truthful_only", only_truthful)) if on]
    named = [label_filter_] if label_filter_ not in (None, "all") else []
    wanted = set(flags + named)
    if len(wanted) > 1:
        raise ValueError(f"label filters contradict: {sorted(wanted)}")
    return wanted.pop() if wanted else "all"


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def first_text(*columns: Column) -> Column:
    """The first column that is not blank."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def optional_int(value: Column) -> Column:
    """A number as text, with thousands commas or inside other text, cut toward zero; booleans and none-words are NULL."""
    s = F.regexp_replace(F.lower(F.trim(value.cast("string"))), ",", "")
    number = F.coalesce(s.try_cast("double"), F.regexp_extract(s, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double"))
    cut = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("long")
    return F.when(s.isin("true", "false", "none", "null", "na", "n/a", "nan", ""), F.lit(None).cast("long")).otherwise(cut)


def direction(value: Column) -> Column:
    s = F.upper(F.trim(value.cast("string")))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, words in DIRECTIONS.items():
        out = out.when(s.isin(words), F.lit(name))
    return out


def try_typed(df, schema: list[tuple[str, str]]):
    """Columns in a fixed order and type: absent ones and values that don't convert are NULL."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(have[n.lower()]).try_cast(t) if n.lower() in have else F.lit(None).cast(t)).alias(n) for n, t in schema])


def card_rank(card: Column, first_digit_only: bool = False) -> Column:
    """A card's rank: its leading 10 or digit, or (the older rule) its first character as a digit."""
    text = F.trim(card.cast("string"))
    if first_digit_only:
        return F.substring(text, 1, 1).try_cast("int")
    return F.regexp_extract(text, "^(10|[1-9])", 1).try_cast("int")
