"""Dictionaries named by settings become the tables that spelling needs; expanded ones are kept as Parquet."""

from __future__ import annotations

import codecs
import hashlib
import os
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import words as W
from ..operators import grammar, lexicon
from . import config as C
from .api import Context


def cached(spark: SparkSession, folder: str | None, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """build()'s table, kept in folder under the digest of key; without a folder, not kept.

    It is written under a name of its own and then renamed, so a table that is there is whole; of two writers the first counts.
    """
    if not folder:
        return build()
    path = f"{folder.rstrip('/')}/{hashlib.sha256(key.encode()).hexdigest()}.parquet"
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        pass
    new = f"{path}-{uuid.uuid4().hex}"
    build().write.parquet(new)
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if files.exists(at) or not files.rename(hadoop.Path(new), at):
        files.delete(hadoop.Path(new), True)
    return spark.read.parquet(path)


def charset(affixes: bytes) -> str:
    """The encoding that an .aff file names for itself and its word list."""
    named = re.search(rb"^SET\s+(\S+)", affixes, re.M)
    return codecs.lookup(named[1].decode()).name if named else "utf-8"


def word_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """value: the lines of a word list; ValueError if it does not begin with a count and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array([content.as_py().decode(encoding)], pa.string())], names=["t"])

    text = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "t string")
    if not text.select(W.is_dictionary(F.col("t"))).first()[0]:
        raise ValueError(f"{path} is no dictionary")
    return text.select(F.explode(F.split("t", "\r?\n")).alias("value"))


def find_extra(name: str, search_dirs: list[str]) -> str:
    """An extra dictionary: a path, or a name in one of the folders."""
    for path in (name, *(os.path.join(d, name) for d in search_dirs)):
        if os.path.isfile(path):
            return path
    raise FileNotFoundError(f"extra dictionary {name} is in none of {search_dirs}")


def load(spark: SparkSession, section: C.Spelling, cache: str | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(form, replacement pairs) of a section's language and extra dictionaries; FileNotFoundError if there is none."""
    pair = C.dictionary_paths(section.lang, section.search_dirs, section.skip_os_lookups)
    if pair is None:
        raise FileNotFoundError(f"no dictionary of {section.lang} in {section.search_dirs} or the system's folders; no word list comes with this package")
    words, affixes = pair
    raw = spark.read.format("binaryFile").load(affixes).first()["content"]
    encoding = charset(bytes(raw))
    told = bytes(raw).decode(encoding)
    extra = [find_extra(x, section.search_dirs) for x in section.extra_dictionaries]
    stamp = "\n".join(f"{p} {os.path.getsize(p)} {os.stat(p).st_mtime_ns}" for p in (words, affixes, *extra))

    def build() -> DataFrame:
        rules = lexicon.affix_table(spark, lexicon.read_affixes(told))
        stems = lexicon.read_words(word_lines(spark, words, encoding))
        for p in extra:
            stems = stems.union(lexicon.read_words(word_lines(spark, p)))
        return lexicon.expand(stems.distinct(), rules).select("form").distinct()

    return cached(spark, cache, stamp, build), lexicon.read_replacements(told)


def context(spark: SparkSession, config: C.Config, cache: str | None = None, **more) -> Context:
    """What check() needs for settings; the first enabled spelling section names the dictionaries, the grammar's section its rules."""
    if config.nlprules and config.nlprules.override_rules:
        more.setdefault("rules", grammar.read_rules(spark, config.nlprules.override_rules))
    section = next((s for s in (config.hunspell, config.zspell, config.spellbook) if s), None)
    if section is None:
        return Context(spark.createDataFrame([], "form string"), config=config, **more)
    forms, pairs = load(spark, section, cache)
    return Context(forms, spark.createDataFrame(pairs, "src string, dst string"), config=config, **more)
