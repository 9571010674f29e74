"""A compiled set of rules: the small, plan-time side of every scan."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keywords import is_valid_keyword_text
from . import dialect
from .families import ENTROPY_FLOOR, FAMILIES, KINDS, assignment

DEFAULT_SEVERITY = "medium"
DEFAULT_CONFIDENCE = 75

# A rule table is metadata. It is collected to compile it, but never past this many rows.
MAX_RULES = 200_000
# Rules above this many bytes of text are scanned in several slices, each one a constant of the plan.
MAX_BROADCAST_BYTES = 8 << 20
# Keyword-less rules run before the indexed ones and so name a value that both find.
INDEXED_RANK_BASE = 1 << 32

RULE_FIELDS = [
    ("rule_id", pa.string()),
    ("name", pa.string()),
    ("category", pa.string()),
    ("provider", pa.string()),
    ("family", pa.string()),
    ("regex", pa.string()),
    ("guard_regex", pa.string()),
    ("confidence", pa.int32()),
    ("severity", pa.string()),
    ("entropy_check", pa.bool_()),
    ("min_entropy", pa.float64()),
    ("min_length", pa.int32()),
    ("max_length", pa.int32()),
    ("tags", pa.list_(pa.string())),
    ("context_keywords", pa.list_(pa.string())),
]
COMPILED_FIELDS = [
    ("ord", pa.int32()),
    ("rank", pa.int64()),
    ("java_regex", pa.string()),
    ("java_guard", pa.string()),
    ("keyword", pa.string()),
    ("ci", pa.bool_()),
    ("indexed", pa.bool_()),
    ("needs", pa.list_(pa.list_(pa.string()))),
    ("needs_run", pa.int32()),
]
COMPILED_SCHEMA = pa.schema(RULE_FIELDS + COMPILED_FIELDS)


def normalise(rule: dict) -> dict:
    """Fill the documented defaults of one rule's fields."""
    row = {name: rule.get(name) for name, _ in RULE_FIELDS}
    row["rule_id"] = row["rule_id"] or rule.get("id")
    row["name"] = row["name"] or row["rule_id"]
    row["severity"] = row["severity"] or DEFAULT_SEVERITY
    row["confidence"] = int(row["confidence"] or DEFAULT_CONFIDENCE)
    row["entropy_check"] = bool(row["entropy_check"])
    row["min_entropy"] = float(row["min_entropy"] or 0.0)
    row["min_length"] = int(row["min_length"] or 0)
    row["max_length"] = int(row["max_length"] or 0)
    row["tags"] = [str(t) for t in row["tags"] or []]
    row["context_keywords"] = [str(t) for t in row["context_keywords"] or []]
    return row


def reject_reason(rule: dict) -> str | None:
    """Why a rule cannot be used, or None."""
    if not rule.get("rule_id"):
        return "rule without an id"
    if not rule.get("regex"):
        return "rule without a regex"
    try:
        regex = dialect.scoped_flags(rule["regex"])
        dialect.to_java(regex)
        dialect.parse(regex)
        if rule.get("guard_regex"):
            dialect.to_java(rule["guard_regex"])
    except (re.error, OverflowError, ValueError) as problem:
        return f"invalid regex: {problem}"
    if dialect.overflows_stack(regex) and dialect.possessive_loops(regex) is None:
        return "unbounded repeat over alternatives or over repeats of varying length, which may have to give back"
    return None


def compile_rule(row: dict, ordinal: int) -> dict:
    regex = dialect.scoped_flags(row["regex"])
    keyword = dialect.rule_keyword(regex)
    indexed = is_valid_keyword_text(keyword)
    ci, _ = dialect.parse(regex)
    guard = row["guard_regex"]
    return {
        **row,
        "ord": ordinal,
        "java_regex": dialect.to_java(dialect.possessive_loops(regex), loops=True) if dialect.overflows_stack(regex) else dialect.to_java(regex),
        "java_guard": dialect.to_java(guard) if guard else None,
        "keyword": keyword or None,
        "ci": ci,
        "indexed": indexed,
        "needs": dialect.needed_literals(regex),
        "needs_run": dialect.needed_run(regex),
        "rank": ordinal + (INDEXED_RANK_BASE if indexed else 0),
    }


@dataclass(frozen=True)
class RuleSet:
    """Validated rules in a fixed order, with everything a scan plan needs from them."""

    rows: tuple[dict, ...]

    @classmethod
    def of(cls, rules) -> "RuleSet":
        """From a RuleSet, a DataFrame of rule fields, or dicts. Rules that share an id all stay, and
        a table without ``ord`` is taken in order of ``rule_id`` and ``regex``."""
        if isinstance(rules, RuleSet):
            return rules
        if isinstance(rules, DataFrame):
            fields = [name for name, _ in RULE_FIELDS if name in rules.columns]
            ordered = rules.orderBy("ord") if "ord" in rules.columns else rules.orderBy("rule_id", "regex")
            table = ordered.select(*fields).limit(MAX_RULES + 1).toArrow()
            if table.num_rows > MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules: this is not a rule table")
            rules = table.to_pylist()
        rows = []
        for rule in rules:
            row = normalise(rule)
            problem = reject_reason(row)
            if problem:
                raise ValueError(f"{row['rule_id']}: {problem}")
            rows.append(compile_rule(row, len(rows)))
        return cls(tuple(rows))

    def __len__(self) -> int:
        return len(self.rows)

    def where(self, keep) -> "RuleSet":
        """The rules for which ``keep(row)`` holds; ordinals stay as they are."""
        return RuleSet(tuple(r for r in self.rows if keep(r)))

    def by_tag(self, tag: str) -> "RuleSet":
        return self.where(lambda r: tag.lower() in (t.lower() for t in r["tags"]))

    def by_severity(self, severity: str) -> "RuleSet":
        return self.where(lambda r: r["severity"].lower() == severity.lower())

    def by_family(self, family: str) -> "RuleSet":
        return self.where(lambda r: r["family"] == family)

    def indexed(self) -> "RuleSet":
        return self.where(lambda r: r["indexed"])

    def union(self, other) -> "RuleSet":
        """These rules followed by ``other`` (user rules), renumbered."""
        return RuleSet.of([*self.rows, *RuleSet.of(other).rows])

    def table(self) -> pa.Table:
        return pa.Table.from_pylist(list(self.rows), schema=COMPILED_SCHEMA)

    def df(self, spark: SparkSession) -> DataFrame:
        """One row per rule. An Arrow table of this size becomes a local relation of known size."""
        application = spark.sparkContext.applicationId
        if application not in self._frames:
            self._frames[application] = spark.createDataFrame(self.table())
        return self._frames[application]

    @cached_property
    def _frames(self) -> dict[str, DataFrame]:
        return {}

    @cached_property
    def nbytes(self) -> int:
        return sum(400 + sum(len(str(value)) for value in r.values()) for r in self.rows)

    def slices(self) -> list["RuleSet"]:
        """Cut so that each part may travel with the plan."""
        count = max(1, -(-self.nbytes // MAX_BROADCAST_BYTES))
        size = max(1, -(-len(self.rows) // count))
        return [RuleSet(self.rows[i : i + size]) for i in range(0, len(self.rows), size)] or [self]

    def screen_spec(self, keyword_only: bool = False, strict_keyword_case: bool = False) -> tuple:
        """``(ord, literal sets, length of the run it needs)`` per rule, for :func:`functions.screen.text_screen`.

        ``keyword_only`` looks for the keyword and nothing else; ``strict_keyword_case`` looks for it
        as it is written, so a case-insensitive rule misses lower-case text.
        """
        spec = []
        for row in self.rows:
            if strict_keyword_case and row["indexed"]:
                spec.append((row["ord"], ((row["keyword"],),), 0))
            elif keyword_only and row["indexed"]:
                spec.append((row["ord"], ((row["keyword"].lower(),),), 0))
            else:
                spec.append((row["ord"], tuple(map(tuple, row["needs"])), row["needs_run"]))
        return tuple(spec)


def _built_in_rules():
    for family in FAMILIES:
        shared = {k: family[k] for k in ("category", "provider", "family")}
        for rule_id, regex, severity, *guard in family["tokens"]:
            yield {
                **shared,
                "rule_id": rule_id,
                "name": rule_id.replace("-", " ").capitalize(),
                "regex": regex,
                "guard_regex": guard[0] if guard else None,
                "severity": severity,
                "confidence": 90 if severity in ("critical", "high") else 70,
                "tags": [family["family"].replace("_", "-"), *rule_id.split("-")],
            }
        for product, kinds in family["assigned"].items():
            label = re.sub(r"[^a-z0-9]+", "-", re.sub(r"\{[^}]*\}|\(\?:|\.\?", "-", product)).strip("-")
            for kind in kinds.split():
                words, value, severity, confidence = KINDS[kind]
                yield {
                    **shared,
                    "rule_id": f"{family['family']}:{label}-{kind}".replace("_", "-"),
                    "name": f"{label.replace('-', ' ')} {kind.replace('-', ' ')}".capitalize(),
                    "regex": assignment(product, words, value),
                    "severity": severity,
                    "confidence": confidence,
                    "entropy_check": kind in ENTROPY_FLOOR,
                    "min_entropy": ENTROPY_FLOOR.get(kind, 0.0),
                    "min_length": 8,
                    "max_length": 4096,
                    "tags": [family["family"].replace("_", "-"), label, kind, "assignment"],
                    "context_keywords": sorted({*label.split("-"), *kind.split("-")}),
                }


@lru_cache(maxsize=1)
def built_in() -> RuleSet:
    """The built-in pack, compiled once per driver process."""
    return RuleSet.of(_built_in_rules())


MATCHER_FIELDS = "ord rank java_regex java_guard entropy_check min_entropy min_length max_length context_keywords".split()
MATCHER = (
    "array<struct<ord:int,rank:bigint,java_regex:string,java_guard:string,entropy_check:boolean,min_entropy:double,"
    "min_length:int,max_length:int,context_keywords:array<string>>>"
)


def rule_array(rules: RuleSet) -> Column:
    """What a scan needs to run the rules, as one constant array in their order."""
    return F.from_json(F.lit(json.dumps([{name: row[name] for name in MATCHER_FIELDS} for row in rules.rows])), MATCHER)


def rule_labels(rules: RuleSet, spark: SparkSession) -> DataFrame:
    """What a finding shows of its rule, keyed by rank."""
    return rules.df(spark).select(
        "rank", "rule_id", F.col("name").alias("type"), "severity", "confidence", "tags", "family"
    )
