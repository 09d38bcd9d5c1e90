"""Label grammar: rules as regular expressions with key templates, compiled to Column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LabelRule:
    """One kind of label. ``anchored`` rules must match from the start; of those the first in order wins.
    Unanchored (band) rules are searched anywhere and add to whatever else a text is."""

    kind: str
    pattern: str
    key: str
    sized_key: str | None = None
    size_unit: float | None = None
    per_building: bool = False
    size_match: str = "both"
    anchored: bool = True
    series: dict = field(default_factory=dict)

    @property
    def groups(self) -> list[str]:
        return re.findall(r"\(\?P<(\w+)>", self.pattern)

    @property
    def java(self) -> str:
        p = self.pattern.replace("(?P<", "(?<")
        return p if not self.anchored or p.startswith("^") else f"^(?:{p})"

    def group(self, text: Column, name: str) -> Column:
        """The text of a named group, '' where it took no part."""
        opened = [m for m in re.finditer(r"\((?!\?)|\(\?P<(\w+)>", re.sub(r"\\.", "..", self.pattern))]
        number = 1 + [m.group(1) for m in opened].index(name)
        return F.regexp_extract(text, self.java, number)

    def filled(self, text: Column, template: str) -> Column:
        parts = re.split(r"\{(\w+)\}", template)
        return F.concat(*[self.group(text, p) if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def rules_of(config: dict) -> tuple[list[LabelRule], list[LabelRule]]:
    """(anchored rules in order, band rules) of a parsed TOML configuration."""
    labels = [
        LabelRule(kind, r["pattern"], r["key"], r.get("sized_key"), r.get("size_unit_m"), r.get("per_building", False), r.get("size_match", "both"), True, r.get("series_subclass", {}))
        for kind, r in config.get("labels", {}).items()
    ]
    bands = [LabelRule(kind, r["label"], r["key"], size_unit=0.01, anchored=False) for kind, r in config.get("bands", {}).items()]
    return labels, bands


def _parsed(text: Column, r: LabelRule) -> Column:
    building = F.nullif(r.group(text, "bld"), F.lit("")) if "bld" in r.groups else F.lit(None).cast("string")
    key, dims = r.filled(text, r.key), F.lit(None).cast("array<double>")
    if r.sized_key and "a" in r.groups:
        a, b = (r.group(text, g).cast("int") * r.size_unit for g in ("a", "b"))
        sized = r.group(text, "a") != ""
        key = F.when(sized, r.filled(text, r.sized_key)).otherwise(key)
        dims = F.when(sized, F.array(F.greatest(a, b), F.least(a, b)))
    kind = F.concat(F.lit(r.kind + ":"), r.group(text, "series")) if "series" in r.groups else F.lit(r.kind)
    return F.struct(kind.alias("kind"), key.alias("key"), building.alias("building"), dims.alias("dims"))


def parsed_labels(texts: DataFrame, text: str, rules: list[LabelRule]) -> DataFrame:
    """``texts`` that a rule matches, with kind, key, building, dims of the first rule that does."""
    t = F.col(text)
    first = None
    for r in rules:
        first = F.when(t.rlike(r.java), _parsed(t, r)) if first is None else first.when(t.rlike(r.java), _parsed(t, r))
    return texts.withColumn("_label", first).filter("_label is not null").select("*", "_label.*").drop("_label")


def band_labels(texts: DataFrame, text: str, rules: list[LabelRule]) -> DataFrame:
    """A row per text and band rule found in it, with kind, key, numbers (the printed section)."""
    t = F.col(text)
    found = F.array(*[F.when(t.rlike(r.java), F.struct(F.lit(r.kind).alias("kind"), r.filled(t, r.key).alias("key"), F.array(*(r.group(t, g).cast("int") / 100 for g in ("a", "b"))).alias("numbers"))) for r in rules])
    return texts.withColumn("_label", F.explode(F.filter(found, lambda x: x.isNotNull()))).select("*", "_label.*").drop("_label")


def is_number(text: Column) -> Column:
    return text.rlike(r"^\d+[.,]\d+$")


def number_of(text: Column) -> Column:
    """Value of a dimension text; null for other texts and for values that are not positive."""
    v = F.when(is_number(text), F.replace(text, F.lit(","), F.lit(".")).cast("double"))
    return F.when(v > 0, v)


def region_word(text: Column, pattern: str, exclude: str | None = None) -> Column:
    hit = text.rlike(pattern)
    return hit & ~text.rlike(exclude) if exclude else hit


def inferred_type(keys: Column | str) -> Column:
    """'~A' for one fitting type, '~A|B' for several, '?' for none."""
    keys = F.col(keys) if isinstance(keys, str) else keys
    return F.when(keys.isNull() | (keys == ""), "?").otherwise(F.concat(F.lit("~"), keys))
