"""Command line: ``reuse`` (best source per target), ``allpairs`` (every pair, by series), ``convert``, ``schema``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from refrain.config import ReuseConfig
from refrain.plans.reuse import run
from refrain.sources.corpus import convert, json_schema

_FLAGS: tuple[tuple[tuple[str, ...], str, str], ...] = (
    (("-i", "--id"), "id", "column of document ids"),
    (("-t", "--text"), "text", "column of texts"),
    (("--locs",), "locs", "column of citation locations"),
    (("--pages",), "pages", "column of pages"),
    (("-l", "--minDF"), "min_df", "least document frequency"),
    (("-u", "--maxDF"), "max_df", "greatest document frequency"),
    (("-m", "--min-match"), "min_match", "least n-gram matches of a pair"),
    (("-n", "--n"), "n", "letters of an n-gram"),
    (("--floating-ngrams",), "floating_ngrams", "n-grams may start within words"),
    (("--complete-lines",), "complete_lines", "edges end at line ends"),
    (("-g", "--gap"), "gap", "greatest gap within a passage"),
    (("--max-offset",), "max_offset", "band of exact alignment (used with --beam 0)"),
    (("--beam",), "beam", "beam of alignment; 0 is exact"),
    (("--pcopy",), "pcopy", "probability of copying a character"),
    (("-a", "--min-align"), "min_align", "least length of a passage"),
    (("--src-overlap",), "src_overlap", "overlap of two sources within a document"),
    (("--dst-overlap",), "dst_overlap", "overlap of source and target within a document"),
    (("-f", "--filterpairs"), "filterpairs", "SQL predicate on pairs"),
    (("--all-pairs",), "all_pairs", "chain every pair by itself"),
    (("--pairwise",), "pairwise", "write alignments of pairs"),
    (("--docwise",), "docwise", "write target documents with witnesses"),
    (("--linewise",), "linewise", "write aligned lines"),
    (("--refpref",), "refpref", "chain sources apart by the field ref"),
    (("--to-index",), "to_index", "stop after the index"),
    (("--to-pairs",), "to_pairs", "stop after the pairs"),
    (("--to-extents",), "to_extents", "stop after the extents"),
    (("--link-model",), "link_model", "formula over metadata"),
    (("--link-features",), "link_features", "SQL features for the formula"),
    (("--log-level",), "log_level", "log level"),
    (("--shards",), "shards", "shards of targets"),
    (("--input-format",), "input_format", "any Spark format"),
    (("--output-format",), "output_format", "any Spark format"),
    (("--seed-start",), "seed_start", "a source's first match may always start a passage"),
)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="refrain", description="Find reused text.", formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    default = ReuseConfig()
    for names, dest, text in _FLAGS:
        value = getattr(default, dest)
        if isinstance(value, bool):
            p.add_argument(*names, dest=dest, action="store_true", help=text)
        else:
            p.add_argument(*names, dest=dest, default=value, type=str if value is None else type(value), help=text)
    p.add_argument("--fields", nargs="+", default=[], help="SQL fields that predicates may use")
    p.add_argument("inputPath")
    p.add_argument("outputPath")
    return p


def configure(args: list[str], preset: str = "reuse") -> tuple[ReuseConfig, str, str]:
    """Settings, input and output; the preset ``allpairs`` compares every pair of different series."""
    if preset == "allpairs":
        args = ["--all-pairs", "--filterpairs", "gid < gid2", *args]
    found = vars(parser().parse_args(args))
    source, target = found.pop("inputPath"), found.pop("outputPath")
    found["fields"] = tuple(found["fields"]) or (("xxhash64(series) as gid",) if preset == "allpairs" else ())
    return ReuseConfig(**found), source, target


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    command = argv.pop(0) if argv and argv[0] in ("reuse", "allpairs", "convert", "schema") else "reuse"
    if command in ("reuse", "allpairs"):
        cfg, source, target = configure(argv, command)
        spark = SparkSession.builder.appName("refrain").getOrCreate()
        spark.sparkContext.setLogLevel(cfg.log_level)
        run(spark, source, target, cfg)
        return 0
    spark = SparkSession.builder.appName("refrain").getOrCreate()
    if command == "convert":
        convert(spark, *argv)
    else:
        print(json_schema(spark, argv[0]))
    return 0


if __name__ == "__main__":
    sys.exit(main())
