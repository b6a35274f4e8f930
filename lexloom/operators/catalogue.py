"""Stage 0: product texts, filters and the join of listings with their images; and corpora of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import clean_words, html_text, normalised, present

# The labels of a product text, in order, and the words that a category must hold one of.
LABELS = {"Title": "title", "Category": "category_path", "Product type": "product_type", "Brand": "brand", "Color": "color", "Material": "material", "Style": "style", "Dimensions": "dimensions", "Description": "description", "Features": "bullet_points"}
KEYWORDS = ("Furniture", "Home & Kitchen", "Home Decor", "Home Décor", "Lighting", "Bedding", "Storage & Organization", "Kitchen & Dining")
PLACEHOLDER_SHARE = 5


def product_template(rows: DataFrame, columns: dict[str, Column | str]) -> Column:
    """Lines of `Label: value`, in the order of LABELS; missing values leave their line empty after the label. Markup in the description goes."""
    value = lambda c: F.coalesce(present(c if isinstance(c, Column) else F.col(c), ""), F.lit("")).cast("string")
    text = lambda k, c: html_text(value(c)) if k == "Description" else value(c)
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), text(k, columns[n]) if n in columns else F.lit("")) for k, n in LABELS.items()))


def with_images(listings: DataFrame, images: DataFrame) -> DataFrame:
    """Listings with the row of their main image; those without one go."""
    return listings.join(images.withColumnRenamed("image_id", "main_image_id"), "main_image_id")


def eligible(listings: DataFrame, keywords: tuple[str, ...] = KEYWORDS, placeholder: int = PLACEHOLDER_SHARE) -> DataFrame:
    """Listings with a title and an image, in a category with one of the keywords, once each by product_id (smallest title
    first), whose image isn't shared by more than `placeholder` products."""
    wanted = F.lit(False)
    for k in keywords:
        wanted = wanted | F.contains(F.coalesce("category_path", F.lit("")), F.lit(k))
    full = listings.where((F.trim(F.coalesce("title", F.lit(""))) != "") & (F.coalesce("main_image_id", F.lit("")) != "") & wanted)
    one = full.groupBy("product_id").agg(F.min_by(F.struct(*(c for c in full.columns if c != "product_id")), F.struct("title", "main_image_id")).alias("r")).select("product_id", "r.*")
    shared = one.groupBy("main_image_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > placeholder).select("main_image_id")
    return one.join(shared, "main_image_id", "left_anti").select(*listings.columns)


def preferred(values: Column, language: str = "en") -> Column:
    """Of an array of (language_tag, value) the first value in the language, else the first."""
    own = F.filter(values, lambda v: F.startswith(F.lower(v["language_tag"]), F.lit(language)))
    return F.coalesce(F.try_element_at(own, F.lit(1))["value"], F.try_element_at(values, F.lit(1))["value"])


def with_image_files(queries: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries to run, queries skipped): an image query needs its image_path among the files (path)."""
    needs = F.col("query_type").isin("image", "image_text")
    known = queries.join(files.select(F.col("path").alias("image_path")).distinct().withColumn("_there", F.lit(True)), "image_path", "left")
    ok = ~needs | F.coalesce("_there", F.lit(False))
    return known.where(ok).drop("_there").select(*queries.columns), known.where(~ok).drop("_there").select(*queries.columns)


CORPUS_COLUMNS = ("title", "author", "description", "genres", "characters")


def build_corpus(rows: DataFrame, columns: tuple[str, ...] = CORPUS_COLUMNS) -> DataFrame:
    """(doc_id, words): the columns' texts after their names, cleaned; rows in which nothing is left go; all columns are required."""
    if lacking := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    text = F.concat_ws(" ", *(x for c in columns for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))))
    names = {c for c in columns}
    return rows.select("doc_id", clean_words(text).alias("words")).where(F.exists("words", lambda w: ~w.isin(*names)))


def preprocess_docs(docs: DataFrame, columns: tuple[str, ...] = ("title", "description", "author")) -> DataFrame:
    """The documents with these texts normalised (arrays item by item); other columns are left alone."""
    kinds = {f.name: f.dataType.typeName() for f in docs.schema}
    return docs.withColumns({c: F.transform(c, normalised) if kinds[c] == "array" else normalised(F.col(c)) for c in columns if c in kinds})
