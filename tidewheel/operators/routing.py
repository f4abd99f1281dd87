"""Owner routing: which owners' patterns cover the paths that a text mentions."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.functions.text import paths


def parse_owners(text: str) -> list[tuple[str, list[str]]]:
    """(pattern, owners) of each rule line; blank lines, comments and lines without @owners are skipped."""
    rules = []
    for line in map(str.strip, text.split("\n")):
        parts = line.split()
        if len(parts) >= 2 and not line.startswith("#") and (owners := [p[1:] for p in parts[1:] if p.startswith("@")]):
            rules.append((parts[0], owners))
    return rules


def owner_rules(spark: SparkSession, text: str) -> DataFrame:
    rows = [(i, p, o, j) for i, (p, os) in enumerate(parse_owners(text)) for j, o in enumerate(os)]
    return spark.createDataFrame(rows, "rule_pos int, pattern string, owner string, owner_pos int")


#: Bytes of an ownership file up to which its automaton is held by every task.
MOST_OWNERS_BYTES = 8 << 20


class RuleMatcher:
    """All ownership patterns in one automaton: a path is read once, whatever the number of rules.

    ``*.ext`` must end the path; any other pattern, without its closing slash, may stand anywhere in it, which takes in equal
    paths and prefixes. Leading slashes do not count. See ``text.path_matches`` for the same of one pattern.
    """

    def __init__(self, patterns: list[tuple[int, str]]):
        needles: dict[str, tuple[list[int], list[int]]] = {}
        self.always: list[int] = []
        for rule, pattern in patterns:
            bare = pattern.removeprefix("/")
            suffix = bare.startswith("*.")
            needle = bare[1:] if suffix else bare.removesuffix("/")
            if needle:
                needles.setdefault(needle, ([], []))[not suffix].append(rule)
            else:
                self.always.append(rule)
        self.automaton = ahocorasick.Automaton()
        for needle, rules in needles.items():
            self.automaton.add_word(needle, rules)
        if needles:
            self.automaton.make_automaton()

    def rules(self, path: str) -> list[int]:
        """Numbers of the rules that cover a path, in ascending order."""
        path = path.removeprefix("/")
        found = set(self.always)
        if path and len(self.automaton):
            for end, (suffixes, anywhere) in self.automaton.iter(path):
                found.update(anywhere)
                if end == len(path) - 1:
                    found.update(suffixes)
        return sorted(found)


def suggest_owners(texts: DataFrame, owners_file: str, top: int = 3) -> DataFrame:
    """``(item_id, rank, owner, pattern)``: the first owners by path, rule and owner position.

    Each task builds the automaton of the file's rules and gives only rows of rules that cover a path; their owners
    come from a table of the file. A file of more than ``MOST_OWNERS_BYTES`` is refused.
    """
    if len(owners_file.encode()) > MOST_OWNERS_BYTES:
        raise ValueError(f"more than {MOST_OWNERS_BYTES} bytes of ownership rules")
    patterns = [(k, p) for k, (p, _) in enumerate(parse_owners(owners_file))]
    found = texts.select("item_id", F.posexplode(paths(F.concat_ws("\n", "title", "body"))).alias("path_pos", "path"))

    def run(batches):
        matcher = RuleMatcher(patterns)
        for batch in batches:
            hits = [matcher.rules(p) for p in batch.column(2).to_pylist()]
            row = pa.array([k for k, h in enumerate(hits) for _ in h], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array([r for h in hits for r in h], pa.int32())], ["item_id", "path_pos", "rule_pos"]
            )

    kind = texts.schema["item_id"].dataType.simpleString()
    covered = found.mapInArrow(run, f"item_id {kind}, path_pos int, rule_pos int")
    hits = covered.join(F.broadcast(owner_rules(texts.sparkSession, owners_file)), "rule_pos")
    first = hits.groupBy("item_id", "owner").agg(F.min(F.struct("path_pos", "rule_pos", "owner_pos", "pattern")).alias("at"))
    order = Window.partitionBy("item_id").orderBy("at.path_pos", "at.rule_pos", "at.owner_pos")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "owner", F.col("at.pattern").alias("pattern"))
