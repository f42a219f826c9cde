"""The secret scan against patterns read by another engine, and its classes on literal cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quarte.llm import ownership as own

SCHEMA = "doc_id long, text string, source string, lang string, row int, value string, class string"
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def scan(spark, rows, rules=own.OwnerRules()):
    df = spark.createDataFrame([(*r, 1, "v", "c") for r in rows], SCHEMA)
    return own.scan(df, F.col("source"), F.concat("source", F.lit("/"), "lang"), rules)


HEX, KEY, BARE = "0123456789abcdef" * 2, "AKIA" + "ABCDEFGH12345678", "aB3dE5fG7hJ9kL1mN2pQ"
CASES = [
    (1, f"token = \"{HEX}\" and Password:abc then SECRET='hunter2x'", "a", "en"),
    (2, f"é\U0001f600 api_key={KEY}: {KEY} AKIASHORT {BARE}", "b", "en"),
    (3, "token: token:abcdef secret=secret=abcdef apikey = 12345", "a", "de"),
    (4, None, "a", "en"),
    (5, "", None, None),
    (6, f"x{HEX}g {'a' * 40} {BARE}", None, "en"),
    (6, f"x{HEX}g {'a' * 40} {BARE}", None, "en"),
    (None, f"pass {BARE}\ntoken={BARE}", "b", None),
    (8, "tokeN=Kabcdef PASSWD=abcdef api_KEY:abcdef", "c", "en"),
    (9, f"{'f' * 30}" * 1000 + " " + "token=abcdef1 " * 2000, "c", "en"),
]


def test_base_findings(spark):
    got = scan(spark, CASES).collect()
    assert len(got) == len(CASES)
    want = sorted((str(d), hashlib.sha256(base(t).encode()).hexdigest()) for d, t, *_ in CASES)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    for r in got:
        text = next(t for d, t, *_ in CASES if d == r.doc_id)
        assert r.n_assign + r.n_access + r.n_hex == len([x for x in base(text).split(",") if x])
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("value")) == base(text)


def test_random_texts(spark):
    rnd = random.Random(1)
    parts = ["token", "TOKEN", "api_key", "=", ":", " ", '"', "abc", "deadbeef0", "AKIA", "ABCD1234EFGH", "é", "😀", ".", "\n", "secret", "-"]
    rows = [(k, "".join(rnd.choices(parts, k=rnd.randrange(60))), "a", "en") for k in range(400)]
    got = {r.doc_id: r for r in scan(spark, rows).collect()}
    for d, text, *_ in rows:
        assert got[d].base_sha256 == hashlib.sha256(base(text).encode()).hexdigest(), text


def test_owners_tell_live_from_copied(spark):
    """One value in one owner's documents is live, the same one with three owners is a copied example."""
    few = [(1, f"see {BARE} here", "a", "en"), (2, f"and {BARE}", "a", "de")]
    got = {r.doc_id: r for r in scan(spark, few).collect()}
    assert got[1].spans == f"value:4:{4 + len(BARE)}" and (got[1].n_value, got[1].n_live) == (1, 1)
    many = [*few, (3, BARE, "b", "en"), (4, BARE, "c", "en")]
    got = {r.doc_id: r for r in scan(spark, many).collect()}
    assert all(r.spans == "" and r.n_value == 0 for r in got.values())
    got = {r.doc_id: r for r in scan(spark, many, own.OwnerRules(max_owners=3)).collect()}
    assert all(r.n_live == 1 for r in got.values())
    dull = scan(spark, [(1, "z" * 30 + "1 token=aaaaaaaa", "a", "en")]).first()
    assert (dull.n_value, dull.n_dull, dull.n_assign) == (0, 1, 1)


def test_counts_by_credential(spark):
    df = spark.createDataFrame([(*r, 1, "v", "c") for r in [(1, f"token={BARE}", "a", "en"), (2, f"token={BARE} {BARE}x", "a", "de"), (3, f"token={BARE}", None, "en")]], SCHEMA)
    _, found = own.findings(df, F.col("source"), F.concat("source", F.lit("/"), "lang"))
    rows = {r.value: r for r in own.credentials(found).collect()}
    assert (rows[BARE].owners, rows[BARE].repos, rows[BARE].uses) == (2, 3, 3)
    assert rows[BARE + "x"].owners == 1


def test_empty_table(spark):
    assert scan(spark, []).count() == 0


@pytest.mark.parametrize("name", ["op12_secret_ownership"])
def test_no_python_in_the_plan(spark, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().toString()
    assert "InArrow" not in plan and "Python" not in plan and "InPandas" not in plan
