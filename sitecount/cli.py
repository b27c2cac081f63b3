"""Command line: ``python -m sitecount -i reads.bam -r reference.fa``."""

from __future__ import annotations

import argparse
import sys

from . import __version__
from .api import Output, format_duration, run
from .plans.pileup import Config
from .schema import DEFAULT_EXCLUDED, CountingError, flag_mask, format_options


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage(sys.stderr)
        self.exit(1, f"{self.prog}: error: {message}\n")


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="sitecount", description="Count bases by site and strand.")
    p.add_argument("-i", "--input", required=True, help="SAM or BAM file")
    p.add_argument("-r", "--reference", required=True, help="FASTA file")
    p.add_argument("-o", "--output", help="output file; standard output if not given")
    p.add_argument("--region", help="contig:start-end, from 1")
    p.add_argument("-t", "--threads", type=int, default=0, help="local cores; all if not given")
    p.add_argument("--engine", choices=("auto", "pileup", "readwalk"), default="auto", help="there is one plan; the choice is accepted and makes no difference")
    p.add_argument("--strandless", action="store_true")
    p.add_argument("--count-indels", action="store_true")
    p.add_argument("--max-depth", type=int, default=0)
    p.add_argument("--vcf", action="store_true")
    p.add_argument("--alleles", action="store_true")
    p.add_argument("-e", "--read-filter", help="expression that keeps or routes bases")
    p.add_argument("-p", "--site-filter", help="expression that keeps sites, by strand")
    p.add_argument("--output-format", help="row template")
    p.add_argument("--fmt-header", help="header of template rows")
    p.add_argument("--motif-pad", type=int, default=0)
    p.add_argument("--target-base", choices=list("ACGTacgt"))
    p.add_argument("--strand", choices=("both", "forward", "reverse"), default="both")
    p.add_argument("-b", "--bedfile")
    p.add_argument("-x", "--exclude")
    p.add_argument("--rf", "--incl-flags", dest="required")
    p.add_argument("--ff", "--excl-flags", dest="excluded")
    p.add_argument("--input-fmt-option")
    p.add_argument("--mate-fix", action="store_true", help="accepted; makes no difference")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("-v", "--version", action="version", version=__version__)
    return p


def config_of(a: argparse.Namespace) -> Config:
    required, excluded = format_options(a.input_fmt_option)
    excluded |= DEFAULT_EXCLUDED if a.excluded is None else flag_mask(a.excluded)
    return Config(required | flag_mask(a.required), excluded, a.strand, None, a.read_filter, a.site_filter, a.max_depth, True, a.motif_pad)


def main(argv: list[str] | None = None, spark=None) -> int:
    """0 when done; 1 for usage, 2 for a bad expression, 3 for unreadable input, 4 for a bad region."""
    a = parser().parse_args(argv)
    try:
        config = config_of(a)
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.master(f"local[{a.threads or '*'}]").appName("sitecount").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        output = Output(a.strandless, a.count_indels, a.vcf, a.alleles, a.output_format, a.fmt_header, a.target_base)
        done = run(spark, a.input, a.reference, a.output, config, output, a.region, a.bedfile, a.exclude)
    except CountingError as e:
        print(f"error: {e}", file=sys.stderr)
        return e.code
    if a.verbose:
        print(f"{done['rows']} rows in {format_duration(done['seconds'])}", file=sys.stderr)
    return 0
