"""License scans (native: DataFrame functions only).

Texts are cut into overlapping windows of word shingles, with widths that follow the sizes of the
templates. MinHash bands of a window retrieve templates, and exact containment of the template's
shingles in the window verifies them. A window without any template shingle cannot verify, so
only windows that hold one are hashed; of the templates, bands alone decide which are verified
there. Everything happens within a row: nothing is shuffled.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import ascii_lower
from tidewake.llm.license_texts import TEMPLATES

SHINGLE, BANDS, THRESHOLD = 5, 32, 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass
class Template:
    name: str
    shingles: list[int]
    bands: list[int]

    @property
    def reach(self) -> int:
        """The power of two that holds the template's shingles: its windows' size class."""
        return 1 << (len(self.shingles) - 1).bit_length()


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """Hashes of all runs of five words; empty if there are fewer."""
    n = F.size(words) - (SHINGLE - 1)
    run = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
    return F.when(n > 0, run).otherwise(F.array().cast("array<bigint>"))


def bands_of(shingles: Column) -> Column:
    """One MinHash value for each band of a single row."""
    return F.transform(F.array(*map(F.lit, range(BANDS))), lambda seed: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, seed))))


def prepare(spark: SparkSession, templates: dict[str, str]) -> list[Template]:
    """Templates of at least five words with their shingles and bands; shorter ones cannot be matched."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string").select("name", words_of(F.col("text")).alias("w"))
    rows = rows.select("name", F.array_distinct(shingles_of(F.col("w"))).alias("s")).select("name", "s", bands_of(F.col("s")).alias("b"))
    return [Template(r["name"], r["s"], r["b"]) for r in rows.collect() if r["s"]]


def _class_matches(shingles: Column, places: Column, reach: int, templates: list[Template]) -> Column:
    """Matches in the windows of one size class: array of (name, first_word, n_words, contained)."""
    step = max(1, reach // 2)
    width = reach + step if reach > 1 else 1  # any run of ``reach`` shingles lies in a window
    rows = [{"name": t.name, "shingles": t.shingles, "bands": t.bands} for t in templates]
    known = F.from_json(F.lit(json.dumps(rows)), "array<struct<name: string, shingles: array<bigint>, bands: array<bigint>>>")  # one constant of the plan
    first = lambda p: F.greatest(F.lit(0), F.ceil((p - (width - 1)) / step).cast("int"))
    numbers = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(first(p), F.floor(p / step).cast("int")))))
    windows = F.transform(numbers, lambda k: F.struct((k * step).alias("at"), F.array_distinct(F.slice(shingles, k * step + 1, F.lit(width))).alias("held")))
    hashed = F.transform(windows, lambda w: F.struct(w["at"].alias("at"), w["held"].alias("held"), bands_of(w["held"]).alias("bands")))

    def verified(w: Column) -> Column:
        near = F.filter(known, lambda t: F.arrays_overlap(t["bands"], w["bands"]))
        tried = F.transform(near, lambda t: F.struct(t["name"].alias("name"), w["at"].alias("first_word"), (F.size(w["held"]) + SHINGLE - 1).alias("n_words"), (F.size(F.array_intersect(t["shingles"], w["held"])) / F.size(t["shingles"])).alias("contained")))
        return F.filter(tried, lambda m: m["contained"] >= THRESHOLD)

    return F.flatten(F.transform(hashed, verified))


def _named(name: str) -> Column:
    return F.filter("__found", lambda m: m["name"] == name)


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` and ``matches``: each template found, where it is contained best.

    A match is (name, first_word, n_words, contained): the earliest of the windows with the
    greatest share, at least 0.8, of the template's shingles. Null and empty texts and texts of
    under five words have no matches; repeated rows stay; columns of the new names are replaced.
    Words are those of the other operators: A-Z lowered. The templates and their bands become a
    constant of the plan, so they should number hundreds at most.
    """
    known = prepare(docs.sparkSession, templates)
    everything = sorted({h for t in known for h in t.shingles})
    out = docs.drop("n_words", "matches").withColumn("__words", words_of(F.col(text)))
    out = out.withColumn("__shingles", shingles_of(F.col("__words"))).withColumn("n_words", F.size("__words").cast("long")).drop("__words")
    marked = F.transform("__shingles", lambda h, i: F.when(h.isin(everything), i))
    out = out.withColumn("__places", F.filter(marked, lambda p: p.isNotNull()))
    classes = sorted({t.reach for t in known})
    empty = F.array().cast("array<struct<name: string, first_word: int, n_words: int, contained: double>>")
    parts = [_class_matches(F.col("__shingles"), F.col("__places"), reach, [t for t in known if t.reach == reach]) for reach in classes]
    found = F.when(F.size("__places") > 0, F.concat(*parts)).otherwise(empty) if parts else empty
    out = out.withColumn("__found", found).drop("__shingles", "__places")
    better = lambda a, b: F.when((b["contained"] > a["contained"]) | ((b["contained"] == a["contained"]) & (b["first_word"] < a["first_word"])), b).otherwise(a)
    best = []
    for t in known:
        own = _named(t.name)
        best.append(F.when(F.size(own) > 0, F.aggregate(own, F.get(own, F.lit(0)), better)))
    chosen = F.filter(F.array(*best), lambda m: m.isNotNull()) if best else empty
    return out.withColumn("matches", F.when(F.size("__found") > 0, chosen).otherwise(empty)).drop("__found")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses that each document contains, and where the first begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_licenses(docs)
    return found.select(
        "doc_id",
        "n_words",
        F.size("matches").cast("long").alias("n_licenses"),
        F.array_join(F.transform("matches", lambda m: m["name"]), ",").alias("licenses"),
        F.array_min(F.transform("matches", lambda m: m["first_word"])).cast("long").alias("first_word"),
        F.array_max(F.transform("matches", lambda m: m["contained"])).alias("best_contained"),
    )
