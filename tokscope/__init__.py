"""tokscope: tokenizer analytics over multilingual text, built on Spark DataFrames.

Layout
------
functions/   Catalyst column expressions (Unicode classes, predicates, slices, seeds)
sources/     readers and writers (text sources, catalogues, result documents)
operators/   the relational building blocks (segmentation, encoding, metrics, reports)
plans/       end-to-end jobs that wire operators together (benchmark run, report tables)
streaming/   Structured Streaming variants of the incremental operators
"""

__version__ = "0.1.0"
