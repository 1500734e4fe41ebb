"""Queries of the thirteen operators over the tables of a data folder, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark, sf_dir):
    from .warc import warc_query

    return warc_query(spark, _table(spark, sf_dir, "pages"))


def op2_bitplane(spark, sf_dir):
    from .bitplane import bitplane_query

    return bitplane_query(spark, _table(spark, sf_dir, "documents"))


def op3_cotrain(spark, sf_dir):
    from .cotrain import quality_query

    return quality_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_license(spark, sf_dir):
    from .license import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op5_separator(spark, sf_dir):
    from .separator import separator_query

    return separator_query(spark, _table(spark, sf_dir, "documents"))


def op6_simhash(spark, sf_dir):
    from .simhash import simhash_query

    return simhash_query(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark, sf_dir):
    from .urlfilter import url_query

    return url_query(_table(spark, sf_dir, "pages"))


def op8_perplexity(spark, sf_dir):
    from .perplexity import quality_query

    return quality_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_decontaminate(spark, sf_dir):
    from .decontam import find_items

    return find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_packing(spark, sf_dir):
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op11_rlz(spark, sf_dir):
    from .rlz import deduplicated

    return deduplicated(_table(spark, sf_dir, "documents"), digest=True)


def op12_lexical(spark, sf_dir):
    from .lexical import lexical_query

    return lexical_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_whitening(spark, sf_dir):
    from .whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from . import lexical, license, rlz, urlfilter, warc

    return {"op1_warc": warc.SQL, "op4_license": license.SQL, "op7_url_filter": urlfilter.SQL, "op11_rlz": rlz.SQL, "op12_lexical": lexical.SQL}
