"""Word lists: .dic and .aff files become tables, affixes are joined on, and forms are what words are looked up in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AFFIX = "kind string, flag string, crosses boolean, strip string, add string, cond string"


def read_affixes(text: str) -> list[tuple[str, str, bool, str, str, str]]:
    """The PFX and SFX rules of an .aff file."""
    crosses: dict[tuple[str, str], bool] = {}
    out = []
    for line in text.splitlines():
        f = line.split()
        if len(f) == 4 and f[0] in ("PFX", "SFX") and f[3].isdigit():
            crosses[f[0], f[1]] = f[2] == "Y"
        elif len(f) >= 5 and f[0] in ("PFX", "SFX"):
            add = "" if f[3] == "0" else f[3].split("/")[0]
            out.append((f[0], f[1], crosses.get((f[0], f[1]), False), "" if f[2] == "0" else f[2], add, "" if f[4] == "." else f[4]))
    return out


def read_replacements(text: str) -> list[tuple[str, str]]:
    """The REP pairs of an .aff file; _ stands for a space."""
    return [(f[1].replace("_", " "), f[2].replace("_", " ")) for f in map(str.split, text.splitlines()) if len(f) == 3 and f[0] == "REP"]


def read_words(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """stem and flags from the lines of a .dic file; the count that it starts with is no word."""
    word = F.split(F.trim(line_col), "/", 2)
    rows = lines.filter(~F.col(line_col).rlike(r"^\s*[0-9]+\s*$") & (F.trim(line_col) != ""))
    return rows.select(F.get(word, F.lit(0)).alias("stem"), F.coalesce(F.get(word, F.lit(1)), F.lit("")).alias("flags")).distinct()


def affix_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rules, AFFIX)


def _suffixed(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (stem, flags) joined to the SFX rules of their flags and conditions: form."""
    hit = rows.join(rules.filter("kind = 'SFX'"), "flag").filter("stem rlike concat(cond, '$') and endswith(stem, strip)")
    return hit.withColumn("form", F.expr("concat(substring(stem, 1, length(stem) - length(strip)), add)"))


def expand(stems: DataFrame, rules: DataFrame) -> DataFrame:
    """stem, form: each stem, its forms with a suffix, with a prefix, and with both where both rules allow it.

    Rules and stems meet by equality of a flag, on either side of a word; Spark broadcasts rules by their size.
    """
    flags = stems.select("stem", F.explode(F.split("flags", "")).alias("flag"), "flags").filter("flag <> ''")
    suffixed = _suffixed(flags, rules)
    prefix = rules.filter("kind = 'PFX'").select(F.col("flag").alias("flag"), F.col("crosses").alias("p_crosses"), F.col("strip").alias("p_strip"), F.col("add").alias("p_add"), F.col("cond").alias("p_cond"))
    bases = stems.select("stem", F.col("stem").alias("form"), "flags").union(suffixed.filter("crosses").select("stem", "form", "flags"))
    put = bases.withColumn("flag", F.explode(F.array_distinct(F.split("flags", "")))).filter("flag <> ''").join(prefix, "flag").filter("form rlike concat('^', p_cond) and startswith(form, p_strip) and (form = stem or p_crosses)")
    put = put.select("stem", F.expr("concat(p_add, substring(form, length(p_strip) + 1))").alias("form"))
    return stems.select("stem", F.col("stem").alias("form")).union(suffixed.select("stem", "form")).union(put).distinct()


def with_extra(forms: DataFrame, *extra: DataFrame) -> DataFrame:
    """forms and the words of extra dictionaries, each once."""
    out = forms.select("form")
    for e in extra:
        out = out.union(e.select("form"))
    return out.distinct()
