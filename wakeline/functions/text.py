"""Text and label normalisers as column expressions. White space is Unicode's throughout, as the label data holds no-break spaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: white space beyond Java's \s: fixed values
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]"

# Surface variants of labels and what they stand for: fixed values
MECHANISM_ALIASES = {
    "switching": "shifting",
    "shift": "shifting",
    "collection completion": "collection expansion",
    "preference deepening": "deepening",
    "preference refinement": "refinement",
    "repeat": "repetition",
}
SCOPE_ALIASES = {
    "same artist": "same creator",
    "same artists": "same creator",
    "same collection series": "same series",
    "same collection": "same series",
    "same series collection": "same series",
    "same broad category": "same category",
    "same broad categories": "same category",
    "same categories": "same category",
    "related category": "adjacent category",
}
DIRECTION_ALIASES = {
    "switch": "shift",
    "shifting": "shift",
    "deepening": "deepen",
    "broadening": "broaden",
    "narrowing": "narrow",
    "repetition": "repeat",
    "returning": "return",
}
ALIASES = {"mechanism": MECHANISM_ALIASES, "scope": SCOPE_ALIASES, "direction": DIRECTION_ALIASES}


def clean_text(c: Column) -> Column:
    """Runs of white space as one blank, ends trimmed; null as ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", " "))


def behavior_value(c: Column) -> Column:
    """Builder's rule: lower case, `_` and `-` as blanks, squeezed; empty as `unknown`."""
    s = F.trim(F.regexp_replace(F.translate(F.lower(clean_text(c)), "_-", "  "), " +", " "))
    return F.when(s == "", "unknown").otherwise(s)


def label_value(c: Column) -> Column:
    """Inference's rule: lower case, everything but ASCII letters and digits as blanks; empty as `unknown`."""
    s = F.trim(F.regexp_replace(F.lower(clean_text(c)), "[^a-z0-9]+", " "))
    return F.when(s == "", "unknown").otherwise(s)


def extraction_value(c: Column) -> Column:
    """Local extraction's rule: lower case, `_` as blank, hyphens kept, trimmed."""
    return F.trim(F.translate(F.lower(clean_text(c)), "_", " "))


def test_label(c: Column) -> Column:
    """Test extraction's rule: lower case, `_` and `-` as blanks, squeezed; empty stays empty."""
    return F.trim(F.regexp_replace(F.translate(F.lower(clean_text(c)), "_-", "  "), " +", " "))


def aliased(c: Column, kind: str) -> Column:
    """The label an alias of this kind (mechanism, scope, direction) stands for; others as they are."""
    pairs = [F.lit(x) for kv in ALIASES[kind].items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


def profile_label(c: Column, kind: str, rule: str = "builder") -> Column:
    return aliased((behavior_value if rule == "builder" else label_value)(c), kind)


def trajectory(signature: Column, alias: Column, rule: str = "builder") -> Column:
    """The trajectory signature, or its alias where it is null, or (builder's rule only) ''."""
    return clean_text(F.coalesce(F.nullif(signature, F.lit("")) if rule == "builder" else signature, alias))


def profile_text(mechanism: Column, scope: Column, direction: Column) -> Column:
    return F.concat(F.lit("mechanism="), mechanism, F.lit("; scope="), scope, F.lit("; direction="), direction)


def cluster_text(mechanism: Column, scope: Column, direction: Column, signature: Column, field: str = "structured_combined") -> Column:
    """What is embedded for clustering: the `how` half of a record only."""
    if field in ("trajectory_signature", "behavior_signature"):
        return clean_text(signature)
    if field != "structured_combined":
        raise ValueError(f"unknown cluster text field {field}")
    return clean_text(F.concat(profile_text(mechanism, scope, direction), F.lit("; trajectory="), signature))


def memory_text(explanation: Column, pattern: Column, keywords: Column) -> Column:
    """Text embedded for a memory: explanation, pattern, keywords; nulls skipped."""
    return F.regexp_replace(F.concat_ws(" ", explanation, pattern, F.array_join(keywords, " ")), f"^{SPACE}+|{SPACE}+$", "")


def memory_id(existing: Column | None, precompute_id: Column | None, thought_id: Column | None, row: Column) -> Column:
    """memory_id, else M + precompute_id, else T + thought_id, else MROW + row number."""
    parts = [F.nullif(existing, F.lit(""))] if existing is not None else []
    parts += [F.concat(F.lit("M"), precompute_id.cast("string"))] if precompute_id is not None else []
    parts += [F.concat(F.lit("T"), thought_id.cast("string"))] if thought_id is not None else []
    return F.coalesce(*parts, F.concat(F.lit("MROW"), row.cast("string")))


def update_weight(evolutions: Column, most: int) -> Column:
    """How strongly a memory may still change: falls from 1 to 0.2 as its evolutions near `most`; rounded half up at 2 decimals."""
    return F.round(F.greatest(F.lit(0.2), F.lit(1.0) - evolutions / F.lit(float(max(most, 1))) * 0.8), 2)
