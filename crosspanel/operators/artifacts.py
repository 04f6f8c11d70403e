"""Generated artifacts: JSON documents with a text response, their static validation and their manifests."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .evaluate import SURVIVED

# Headings that a response must have; what in its code hints at data beyond prices and volume, and the whole
# word that does; and what in it fills, drops or bounds values.
SECTIONS = tuple(f"Section {i}" for i in range(1, 6))
FORBIDDEN = ("vwap", "market_cap", "marketcap", "indclass", "industry", "sector", "adv20_cap", "shares_outstanding", "float")
FORBIDDEN_WORD = "cap"
WATCHED = ("fillna", "ffill", "bfill", "pad(", "interpolate", "clip", "replace", "dropna", "np.inf", "inf)")
FENCE = "```"
# What counts as white space between words.
_WHITE = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"

METADATA = T.StructType([T.StructField(n, T.StringType()) for n in ("alpha_id", "model", "provider", "theme", "generation_status", "run_id")] + [T.StructField("call_index", T.IntegerType())])
SCHEMA = T.StructType([T.StructField("metadata", METADATA), T.StructField("raw_response", T.StringType()), T.StructField("response_sha256", T.StringType())])


def read_artifacts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row for each JSON file, or for each of its ``lines``, as ``write_json`` leaves them; ids fall back on the file's name."""
    raw = spark.read.schema(SCHEMA).json(path, multiLine=not lines)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+?)(\.json)?$", 1)
    return raw.select(F.coalesce("metadata.alpha_id", stem).alias("alpha_id"), "metadata.model", "metadata.theme", F.col("metadata.generation_status").alias("status"), "raw_response", "response_sha256")


def first_code_block(text: Column) -> Column:
    """Body of the first fence marked as Python, else of the first bare one, with its last line's end; NULL without any.

    The body begins with the line after the fence, though it be blank, and ends before the first line that begins with a fence:
    one within a line is text.
    """
    marked, bare = F.regexp_extract(text, r"(?s)```python[^\S\n]*\n(.*?\n)```", 1), F.regexp_extract(text, r"(?s)```[^\S\n]*\n(.*?\n)```", 1)
    return F.when(marked != "", marked).when(bare != "", bare)


def last_code_block(text: Column) -> Column:
    """What follows the first line after the last fence but one, up to the last; NULL with fewer than two fences or without that line's end.

    Fences may overlap: four backticks are two. Both are found from the end, in the reversed text.
    """
    back = F.reverse(text)
    last = F.locate(FENCE, back)
    before = F.when(last > 0, F.call_function("locate", F.lit(FENCE), back, last + 1))
    block = F.when(before > 0, F.substring(text, F.length(text) - before - 1, before - last))
    line = F.locate("\n", block)
    return F.when(line > 0, F.substring(block, line + 1, F.length(block)))


def missing_sections(text: Column, sections: tuple[str, ...] = SECTIONS) -> Column:
    return F.filter(F.array(*map(F.lit, sections)), lambda s: ~F.contains(text, s))


def token_hits(text: Column, tokens: tuple[str, ...]) -> Column:
    """Which of the tokens the lower-cased text contains, in their order."""
    return F.filter(F.array(*map(F.lit, tokens)), lambda t: F.contains(F.lower(text), t))


def has_word(text: Column, word: str) -> Column:
    """Whether the lower-cased text has the word between white space, brackets, dots, commas and equals signs around it aside."""
    return F.exists(F.split(F.lower(text), _WHITE), lambda w: F.btrim(w, F.lit("(),.[]= ")) == word)


def data_tokens(code: Column, tokens: tuple[str, ...] = FORBIDDEN, word: str = FORBIDDEN_WORD) -> Column:
    """The tokens that the code contains, and the word last if it occurs on its own."""
    return F.concat(token_hits(code, tokens), F.when(has_word(code, word), F.array(F.lit(word))).otherwise(F.array().cast("array<string>")))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def slug(text: Column) -> Column:
    return F.translate(F.lower(text), "- ", "__")


def validate(artifacts: DataFrame, text: str = "raw_response", sections: tuple[str, ...] = SECTIONS, tokens: tuple[str, ...] = FORBIDDEN, word: str = FORBIDDEN_WORD, watched: tuple[str, ...] = WATCHED) -> DataFrame:
    """Static flags of each response; all are NULL where the call failed and there is none.

    Sections are looked for in the whole response; tokens, words and syntax in its last code block alone, and without one their
    lists are empty. Nothing is executed and nothing is left out for its flags.
    """
    t, code = F.col(text), F.col("_code")
    none = F.array().cast("array<string>")
    inside = lambda flag, empty: F.when(code.isNotNull(), flag).otherwise(empty)
    tree = F.col("_tree")
    flags = {
        "missing_sections": missing_sections(t, sections), "code_block_found": code.isNotNull(), "code_parses": inside(tree["parses"], F.lit(False)), "generate_alpha_defined": inside(tree["defines"], F.lit(False)),
        "keyword_args": inside(tree["keywords"], none), "has_keyword_args": inside(F.size(tree["keywords"]) > 0, F.lit(False)), "negative_shift_present": inside(tree["negative_shift"], F.lit(False)),
        "forbidden_data_tokens": inside(data_tokens(code, tokens, word), none), "fidelity_watch_tokens": inside(token_hits(code, watched), none), "syntax_error": tree["error"], "response_sha256": content_hash(t),
    }
    parsed = artifacts.withColumn("_code", last_code_block(t)).withColumn("_tree", code_flags("_code"))
    return parsed.withColumns({name: F.when(t.isNotNull(), flag) for name, flag in flags.items()}).drop("_code", "_tree")


CODE_FLAGS = T.StructType([T.StructField("parses", T.BooleanType()), T.StructField("defines", T.BooleanType()), T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("negative_shift", T.BooleanType()), T.StructField("error", T.StringType())])


@F.pandas_udf(CODE_FLAGS)
def code_flags(code: pd.Series) -> pd.DataFrame:
    """What a block of code defines, by its syntax tree; nothing is executed.

    ``keywords`` are ``generate_alpha``'s arguments with defaults and its keyword-only ones; ``negative_shift`` is a look-ahead by a
    negative number in any place of a call of ``shift``, also as a keyword. A very deep tree is an error like a wrong one.
    """

    def backwards(value: ast.expr) -> bool:
        return isinstance(value, ast.UnaryOp) and isinstance(value.op, ast.USub) or isinstance(value, ast.Constant) and type(value.value) is int and value.value < 0

    def one(text: str | None) -> tuple:
        if text is None:
            return None, None, None, None, None
        try:
            nodes = list(ast.walk(ast.parse(text)))
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            return False, False, [], False, str(e)
        defined = [n.args for n in nodes if isinstance(n, ast.FunctionDef) and n.name == "generate_alpha"]
        words = [a.arg for a in (defined[-1].args[-len(defined[-1].defaults) :] if defined[-1].defaults else []) + defined[-1].kwonlyargs] if defined else []
        shifts = [n for n in nodes if isinstance(n, ast.Call) and (getattr(n.func, "attr", None) or getattr(n.func, "id", None)) == "shift"]
        return True, bool(defined), words, any(backwards(v) for n in shifts for v in [*n.args, *(k.value for k in n.keywords)]), None

    return pd.DataFrame([one(c) for c in code], columns=[f.name for f in CODE_FLAGS])


def generation_status(retrieval: Column, text: Column, failed: Column) -> Column:
    """Status of a call: a failed one is an error; an empty or missing text is an empty response, whatever was retrieved; what
    shows evidence of retrieval is quarantined, since its cutoff is then the day it was made. White space is a text.

    ``retrieval`` and ``failed`` are booleans, NULL counts as false.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(failed), "api_error").when(F.coalesce(F.length(text), F.lit(0)) == 0, "empty_response").when(yes(retrieval), "quarantined_retrieval_detected").otherwise("success")


def manifest(artifacts: DataFrame, text: str = "raw_response", statuses: tuple[str, ...] = (), themes: tuple[str, ...] = (), status: str = "status", theme: str = "theme") -> DataFrame:
    """``n, n_responses, n_duplicates`` and ``n_<status>``, ``theme_<slug>`` of the listed statuses and themes: one row.

    Responses that equal an earlier one count as duplicates.
    """
    counts = [F.count_if(F.col(status) == v).alias(f"n_{v}") for v in statuses] + [F.count_if(slug(F.col(theme)) == v).alias(f"theme_{v}") for v in themes]
    return artifacts.agg(*counts, F.count(F.lit(1)).alias("n"), F.count(text).alias("n_responses"), (F.count(text) - F.countDistinct(F.sha2(F.col(text), 256))).alias("n_duplicates"))


def balance(artifacts: DataFrame, by: str, each: int) -> DataFrame:
    """Groups whose number of artifacts isn't ``each``; empty if the plan is balanced."""
    return artifacts.groupBy(by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != each)


def call_plan(themes: DataFrame, samples: int) -> DataFrame:
    """``theme, sample, call_index``: each theme (column ``theme``) so many times; calls are numbered by theme, then sample. Themes are some ten."""
    placed = themes.select("theme").distinct().withColumn("no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("theme")) - 1)
    return placed.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).select("theme", "sample", (F.col("no") * samples + F.col("sample")).cast("int").alias("call_index"))


def leak_plan(spark: SparkSession, weights: tuple[float, ...], bases: list[str], replicates: int = 8) -> DataFrame:
    """``alpha_id, weight, base``: replicates of each weight over the bases, cyclically."""
    rows = [(f"leak_w{round(100 * w):02d}_{i}", w, bases[i % len(bases)]) for w in weights for i in range(replicates)]
    return spark.createDataFrame(rows, "alpha_id string, weight double, base string")


def survivors(artifacts: DataFrame, screening: DataFrame) -> DataFrame:
    """Artifacts of surviving signals. Fails if a survivor has no artifact: a corpus is never silently a subset."""
    kept = screening.filter(F.col("status") == SURVIVED).select("alpha_id").distinct()
    lost = kept.join(artifacts, "alpha_id", "left_anti")
    if missing := [r["alpha_id"] for r in lost.orderBy("alpha_id").limit(5).collect()]:
        raise ValueError(f"survivors without an artifact, such as {missing}")
    return artifacts.join(kept, "alpha_id", "left_semi")


# Why formulas of the published hundred and one are left out, by number.
EXCLUSIONS = {
    ("data_availability", "vwap"): (5, 11, 25, 27, 32, 36, 41, 47, 50, 57, 61, 62, 64, 65, 66, 71, 72, 73, 74, 75, 77, 78, 81, 83, 84, 86, 94, 96, 98),
    ("data_availability+execution", "vwap"): (42,),
    ("data_availability", "market cap"): (56,),
    ("data_availability", "industry"): (58, 59, 63, 67, 69, 70, 76, 79, 80, 82, 87, 89, 90, 91, 93, 97, 100),
    ("data_availability+execution", "industry"): (48,),
    ("execution_convention", "delay 0"): (53, 54),
}


def control_manifest(spark: SparkSession, included: dict[int, tuple[int, list[str]]]) -> DataFrame:
    """``number, alpha_id, included, exclusion_basis, reason, n_parameters, required_inputs`` of all 101 published formulas, in their order.

    ``included`` has the number of parameters and the fields of each formula that is kept. Fails if the two lists don't cover 1 to 101 once.
    """
    rows = [(n, f"alpha_k{n:03d}", True, None, None, *p) for n, p in included.items()]
    rows += [(n, None, False, basis, reason, None, None) for (basis, reason), numbers in EXCLUSIONS.items() for n in numbers]
    if sorted(r[0] for r in rows) != list(range(1, 102)):
        raise ValueError("the manifest must have each of 101 formulas once")
    return spark.createDataFrame(sorted(rows, key=lambda r: r[0]), "number int, alpha_id string, included boolean, exclusion_basis string, reason string, n_parameters int, required_inputs array<string>")


def with_coverage(manifest: DataFrame, panel: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Adds ``n_rows``: rows of the panel that have all of a formula's inputs. The panel is counted once for each set of fields that rows have."""
    seen = panel.groupBy(F.array(*(F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields)).alias("_have")).agg(F.count(F.lit(1)).alias("_n"))  # at most 2 ** fields rows
    met = manifest.join(F.broadcast(seen), F.size(F.array_except("required_inputs", "_have")) == 0, "left")
    return met.groupBy(*manifest.columns).agg(F.sum("_n").alias("n_rows"))


def copy_survivors(artifacts: DataFrame, screening: DataFrame, path: str) -> None:
    """Write the artifacts of surviving signals as JSON, one document a line."""
    write_json(survivors(artifacts, screening), path)


def write_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON, one document a line; missing fields are written as null."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
