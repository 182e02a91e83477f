"""Every registered query against its SQL, run by DuckDB over the same files."""

import math
import os

import duckdb
import pytest

from dossier.plans import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLES:
        return
    got = duck.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)


ODD_TEXTS = [
    None,
    "",
    "   \n ",
    "# Top\nsaid and\n the rest\n## Sub\n# Last  \nend",
    "Dear all,\nE-Mail: a@b.example\nM: +30 210 99\n_________\nDISCLAIMER: this is\nkept private\n\nStill here\n\n\n\nBest regards,\nX",
    "CONFIDENTIAL to all\nsecond line\n",
    'a ![x](image_3.png) b [q]](image) <img alt="z" src="1"/> ![k](foo) [n](http://x.example) ![r](page_1_p) [s](layout_2_a)',
    'M/V Green Star met vessel: The Sea Owl and "RED MOON" near "THE PORT" on M/T. Blue',
    " ".join(f"w{i}" for i in range(60)),
    "x\n" * 400,
]


@pytest.mark.parametrize("name", "t07_boilerplate t09_anchor t13_image_references t22_line_numbers t27_excerpts t30_token_truncate t40_candidates w07_heading_path".split())
def test_odd_texts(spark, tmp_path, name):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute("SELECT " + ", ".join(f'"{k}"' for k in columns) + f" FROM ({ORACLES[name]})").fetchall()
    assert sorted((tuple(r[k] for k in columns) for r in df.collect()), key=repr) == sorted(want, key=repr)


def held_to_sql(spark, folder, name, rows, schema, source):
    """The query's rows over a made table equal those of its SQL."""
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{source}.parquet")
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {source} AS SELECT * FROM '{folder}/{source}.parquet/*.parquet'")
    want = c.execute("SELECT " + ", ".join(f'"{k}"' for k in columns) + f" FROM ({ORACLES[name]})").fetchall()
    assert sorted((tuple(r[k] for k in columns) for r in df.collect()), key=repr) == sorted(want, key=repr)
    assert want


SHAPES = [
    None, "", "\x0b", "#\x0bh", "\r# h", "\x85# q\u2028# q", "\u00a0| x", "\u3000a b c\x0bd", "\n#\n x\x0b", "a b c\u2003", "a b c \t", "\t\u2003w",
    *("\n".join(["|x"] * d + ["a b c d"] * (n - d)) for n, d in ((128, 1), (640, 41), (640, 323))), *("\n".join(f"w{min(i, d - 1)} a" for i in range(640)) for d in (307, 317)),
]


def test_content_shape_of_odd_lines(spark, tmp_path):
    """White space that only one of the engines' patterns counts, empty texts, shares that lie between two sixth decimals."""
    held_to_sql(spark, tmp_path, "t24_content_shape", list(enumerate(SHAPES)), "doc_id bigint, text string", "documents")


def test_sizes_that_lie_between_two_digits(spark, tmp_path):
    sizes = [None, 0, 1, 1023, 1024, 1075, 1076, 1279, 1280, 1281, 1792, 2304, 2816, 1048575, 1048576, 1310720, 1835008, 2359296]
    held_to_sql(spark, tmp_path, "t39_sizes", [(i, None if n is None else "é" * n) for i, n in enumerate(sizes)], "page_id bigint, html string", "pages")


def test_lost_roots_in_tables_of_over_a_million_keys(spark, tmp_path):
    """The keys that a lost root is named after may be there; repeated, negative and null keys."""
    keys = [*range(40), *range(1000000, 1000040), 2000005, 5, 5, -6, -17, None]
    held_to_sql(spark, tmp_path, "q33_thread_roots", [(k,) for k in keys], "o_orderkey bigint", "orders")
