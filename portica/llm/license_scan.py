"""License scans with DataFrame functions only.

Documents have a place in a directory tree. Units of a document are compared to templates by the cosine of sparse
TF-IDF vectors, with document frequencies of all terms over the whole corpus: lines, blocks of lines and headers to
notices and licence texts, the opening and the whole text to licence texts. A document with a unit that matches has that licence
itself. It is a licence file, and speaks for its directory, if its whole text or its opening matches a licence
text, or if most of its words stand in matched lines. Every other document takes the licence of its nearest
ancestor directory that has one, found by a join on paths.

Which units need a comparison follows from the templates: their most frequent terms, as far as they weigh less
than the threshold together in every template, cannot reach it alone. A unit without one of the other, telling
terms is never a match, and the few documents with such a term are all that is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .exchange import saved
from .license_texts import NOTICES, TEXTS

THRESHOLD = 0.5
#: A licence file: at least this share of its words stands in matched lines.
FILE_SHARE = 0.5
#: Terms of a document's opening.
OPENING = 120

_TERM = r"[a-z0-9](?:[a-z0-9.\-]*[a-z0-9])?"
#: Leading lines that begin as comments do.
_COMMENT = r"^\s*(?:[ \t]*(?:#|//|/\*|\*|--|;|%|<!--)[^\n]*(?:\n|$))+"


def terms_of(text: Column) -> Column:
    """Lower-case runs of letters, digits, dots and hyphens that hold a letter or digit at both ends; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TERM), F.lit(0))


def templates_frame(spark: SparkSession) -> DataFrame:
    """(license, notice, whole, template): a row for each template; `whole` marks licence texts."""
    rows = [(name, f"{name}/{i}", False, text) for name, texts in NOTICES.items() for i, text in enumerate(texts)]
    rows += [(name, f"{name}/text", True, text) for name, text in TEXTS.items()]
    return spark.createDataFrame(rows, "license string, notice string, whole boolean, template string")


def _inverse(df: Column, total: int) -> Column:
    return F.log((F.lit(total) + 1) / (df + 1)) + 1


def _template_vectors(spark: SparkSession, frequencies: DataFrame, total: int) -> list:
    """Rows (license, notice, whole, term, unit, df) with unit vectors; as many as the fixed templates have terms."""
    tf = templates_frame(spark).withColumn("term", F.explode(terms_of(F.col("template")))).groupBy("license", "notice", "whole", "term").agg(F.count("*").alias("tf"))
    tf = tf.join(frequencies, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("w", F.col("tf") * _inverse(F.col("df"), total))
    norm = tf.groupBy("notice").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return tf.join(norm, "notice").select("license", "notice", "whole", "term", (F.col("w") / F.col("norm")).alias("unit"), "df").collect()


def telling_terms(vectors: list, threshold: float) -> list[str]:
    """Template terms of which every match has one: all but the most frequent that stay below the threshold together."""
    left = {r["notice"]: threshold * threshold * (1 - 1e-9) for r in vectors}
    by_term: dict[tuple[int, str], list] = {}
    for r in vectors:
        by_term.setdefault((-r["df"], r["term"]), []).append((r["notice"], r["unit"] ** 2))
    telling = []
    for (_, term), parts in sorted(by_term.items()):
        if all(left[notice] > square for notice, square in parts):
            for notice, square in parts:
                left[notice] -= square
        else:
            telling.append(term)
    return telling


def _has(terms: Column, telling: list[str]) -> Column:
    return F.arrays_overlap(terms, F.array(*map(F.lit, telling))) if telling else F.lit(False)


def _units(candidates: DataFrame, telling: list[str], telling_whole: list[str]) -> DataFrame:
    """(row, n_words, kind, place, terms): what is compared of each candidate; only units with a telling term."""
    one = lambda kind, text: F.array(F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("place"), terms_of(text).alias("terms")))
    many = lambda kind, texts: F.transform(texts, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), terms_of(x).alias("terms")))
    opening = F.array(F.struct(F.lit("opening").alias("kind"), F.lit(0).alias("place"), F.slice(terms_of(F.col("text")), 1, OPENING).alias("terms")))
    blocks = F.filter(F.split("text", r"\n[ \t\r]*\n"), lambda b: F.contains(F.trim(b), F.lit("\n")))
    parts = F.concat(many("line", F.split("text", "\n")), many("block", blocks), one("header", F.regexp_extract("text", _COMMENT, 0)))
    whole = F.concat(opening, one("file", F.col("text")))
    some = F.concat(F.filter(parts, lambda u: _has(u["terms"], telling)), F.filter(whole, lambda u: _has(u["terms"], telling_whole)))
    return candidates.select("row", F.size(terms_of(F.col("text"))).alias("n_words"), F.inline(some))


def similarities(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row, n_words, kind, place, line_words, license, notice, whole, similarity): units of `docs(row, text)` that match."""
    spark = docs.sparkSession
    terms = docs.select(F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
    in_templates = [r["term"] for r in templates_frame(spark).select(F.explode(terms_of(F.col("template"))).alias("term")).distinct().collect()]
    # A term of the corpus that is not in this table stands in one document.
    frequencies = saved(terms.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") > 1) | F.col("term").isin(in_templates)))
    total = docs.count()
    vectors = _template_vectors(spark, frequencies, total)
    telling, telling_whole = telling_terms(vectors, threshold), telling_terms([r for r in vectors if r["whole"]], threshold)
    hint = _has(terms_of(F.col("text")), sorted({*telling, *telling_whole}))
    units = saved(_units(docs.where(hint).dropDuplicates(["row"]), telling, telling_whole).withColumn("unit", F.xxhash64("row", "kind", "place")))
    counts = units.select("unit", F.explode("terms").alias("term")).groupBy("unit", "term").agg(F.count("*").alias("tf"))
    weighted = saved(counts.join(frequencies, "term", "left").select("unit", "term", (F.col("tf") * _inverse(F.coalesce("df", F.lit(1)), total)).alias("w")))
    norm = weighted.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    table = spark.createDataFrame([(r["license"], r["notice"], r["whole"], r["term"], r["unit"]) for r in vectors], "license string, notice string, whole boolean, term string, share double")
    dots = weighted.join(F.broadcast(table), "term").groupBy("unit", "license", "notice", "whole").agg(F.sum(F.col("w") * F.col("share")).alias("dot"))
    found = dots.join(norm, "unit").withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("similarity") >= threshold)
    named = units.select("unit", "row", "n_words", "kind", "place", F.size("terms").alias("line_words"))
    return named.join(found, "unit").where(F.col("whole") | ~F.col("kind").isin("opening", "file")).select("row", "n_words", "kind", "place", "line_words", "license", "notice", "whole", "similarity")


def own_licenses(matches: DataFrame) -> DataFrame:
    """(row, own_license, similarity, is_license_file) from similarities(); the licence first by name among equals."""
    lines = matches.where("kind = 'line'").select("row", "n_words", "place", "line_words").distinct()
    mostly = lines.groupBy("row").agg((F.sum("line_words") / F.max("n_words") >= FILE_SHARE).alias("mostly"))
    is_text = F.col("whole") & F.col("kind").isin("file", "opening")
    best = matches.groupBy("row").agg(
        F.min(F.struct((-F.col("similarity")).alias("less"), "license")).alias("any"),
        F.min(F.when(is_text, F.struct((-F.col("similarity")).alias("less"), "license"))).alias("text"),
    )
    # What a licence file is follows from its whole text or opening, whatever single lines say.
    chosen = F.coalesce("text", "any")
    return best.join(mostly, "row", "left").select(
        "row", chosen["license"].alias("own_license"), (-chosen["less"]).alias("similarity"), (F.col("text").isNotNull() | F.coalesce("mostly", F.lit(False))).alias("is_license_file")
    )


def parent_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def nearest_ancestors(paths: DataFrame, speakers: DataFrame) -> DataFrame:
    """(own_dir, dir, depth, dir_license) for each directory of `paths(path)` with a speaker in it or above.

    `speakers(dir, dir_license)` has one row for each directory. Distinct directories meet their ancestors by
    path; a directory with many documents counts once.
    """
    parts = F.split("own_dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("dir"), n.alias("depth")))
    dirs = paths.where("path <> ''").select(parent_of(F.col("path")).alias("own_dir")).distinct().select("own_dir", F.inline(above))
    return dirs.join(speakers, "dir").groupBy("own_dir").agg(F.max(F.struct("depth", "dir", "dir_license")).alias("n")).select("own_dir", "n.*")


def inherit(places: DataFrame, own: DataFrame, speakers: DataFrame) -> DataFrame:
    """`places(row, path)` with own licences and, where there is none, that of the nearest ancestor directory."""
    nearest = nearest_ancestors(places.select("path"), speakers)
    named = places.withColumn("own_dir", F.when(F.col("path") != "", parent_of(F.col("path")))).join(own.withColumnRenamed("row", "own_row"), F.col("row").eqNullSafe(F.col("own_row")), "left")
    return named.join(nearest, "own_dir", "left").select(
        "row",
        "path",
        "own_license",
        "similarity",
        F.coalesce("is_license_file", F.lit(False)).alias("is_license_file"),
        F.coalesce("own_license", "dir_license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("dir")).alias("inherited_from"),
        F.when(F.col("own_license").isNull(), F.col("depth")).alias("depth"),
    )


def scan(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """(id, path, own_license, similarity, is_license_file, license, inherited_from, depth) for each row.

    `path` is slash-separated; its last part is the document. A null path is '' and neither gives nor takes.
    Null and empty texts have no own licence but may inherit. Among equal similarities the licence first by
    name wins, in a directory with several licence files the one of greatest similarity. Rows are judged by their
    own text, so rows that repeat an id may differ; repeated rows each get a row; an empty table gives none. Other
    columns are not read, so their names may clash with any of these.
    """
    path = F.coalesce(docs[path_col], F.lit(""))
    row = F.struct(docs[id_col].alias("id"), path.alias("path"), F.xxhash64(docs[text_col]).alias("hash"), F.octet_length(docs[text_col]).alias("bytes"))
    base = docs.select(row.alias("row"), path.alias("path"), docs[text_col].alias("text"))
    own = saved(own_licenses(similarities(base.select("row", "text"), threshold)))
    said = own.where("is_license_file and row.path <> ''")
    speakers = said.groupBy(parent_of(F.col("row.path")).alias("dir")).agg(F.min(F.struct((-F.col("similarity")).alias("less"), "own_license")).alias("s")).select("dir", F.col("s.own_license").alias("dir_license"))
    return inherit(base.select("row", "path"), own, speakers).select(F.col("row.id").alias(id_col), "path", "own_license", "similarity", "is_license_file", "license", "inherited_from", "depth")


def placed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The documents with a path from source and id: source / ten thousands / thousands / id.txt."""
    n = F.col(id_col)
    parts = [F.coalesce(F.col(source_col), F.lit("")), F.floor(n / 10_000).cast("string"), F.floor(n / 1000).cast("string"), F.concat(n.cast("string"), F.lit(".txt"))]
    return docs.withColumn("path", F.concat_ws("/", *parts))
