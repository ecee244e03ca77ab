"""Language rank (W4) and categories (U2, U3, J5) on a hand-made catalogue, expected values by hand."""

from tokscope.operators import report as R

NAT_SCHEMA = "catalog_pos int, name string, script string, iso_code string, disk_size string, subset string, family string"


def test_rank_and_categories(spark):
    nat = spark.createDataFrame(
        [
            (0, "French", "Latn", "fra", "1 TB", "fra_Latn", "Indo-European"),
            (1, "German", "Latn", "deu", "2 TB", "deu_Latn", "Indo-European"),
            (2, "Basque", "Latn", "eus", "10 GB", "eus_Latn", "Language isolate"),
            (3, "Japanese", "Jpan", "jpn", "500 GB", "jpn_Jpan", "Japonic"),
            (4, "Total", "Total", "Total", "9 TB", None, None),
        ],
        NAT_SCHEMA,
    )
    code = spark.createDataFrame([(0, "Python (code)"), (1, "Java (code)")], "catalog_pos int, name string")
    langs = [
        ("English (FineWeb)", "Latn"), ("French", "Latn"), ("Basque", "Latn"), ("Japanese", "Jpan"),
        ("Python (code)", "code"), ("Klingon", "Latn"),
    ]
    present = spark.createDataFrame([(n,) for n, _ in langs], "language string")
    ranks = {r["language"]: r["language_rank"] for r in R.rank_table(present, nat, code).collect()}
    # English 0; natural by size: German 1 (absent, still counted), French 2, Japanese 3, Basque 4;
    # code in file order: Python 5, Java 6 (absent); uncatalogued by name: Klingon 7
    assert ranks == {"English (FineWeb)": 0, "French": 2, "Japanese": 3, "Basque": 4, "Python (code)": 5, "Klingon": 7}

    rows = spark.createDataFrame(
        [("t", f"{n}-k", n, s, ranks[n]) for n, s in langs],
        "tokenizer_key string, lang_key string, language string, script string, language_rank int",
    )
    cats = R.language_categories(R.language_table(rows, nat)).collect()
    by = {}
    for r in sorted(cats, key=lambda r: (r["category"], r["position"])):
        by.setdefault(r["category"], []).append(r["language"])
    assert by["All Languages"] == ["English (FineWeb)", "French", "Japanese", "Basque", "Klingon", "Python (code)"]
    assert by["Top 30 Natural"] == ["English (FineWeb)", "French", "Japanese", "Basque", "Klingon"]
    assert by["Coding"] == ["Python (code)"]
    assert by["European"] == ["French", "Basque"]  # Basque by exception; Klingon has no family
    assert by["Non-European"] == ["Japanese", "Klingon"]
    assert by["CJK Scripts"] == ["Japanese"]
    assert by["Latin Script"] == ["English (FineWeb)", "French", "Basque", "Klingon"]
    assert "31–60 Natural" not in by
