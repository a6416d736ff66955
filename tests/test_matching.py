import random

from foliora.operators import matching as M
from foliora.sources.files import known_names, load_names


def lcs(a, b):
    d = [0] * (len(b) + 1)
    for x in a:
        p = 0
        for j, y in enumerate(b):
            p, d[j + 1] = d[j + 1], p + 1 if x == y else max(d[j + 1], d[j])
    return d[-1]


def brute(token, names, cutoff=80):
    t = " ".join(sorted(token.split()))
    best = None
    for k, n in names:
        s = " ".join(sorted(n.split()))
        r = 200 * lcs(t, s) / (len(t) + len(s)) if t or s else 0
        if r >= cutoff and (best is None or r > best[0]):
            best = (r, n)
    return best


def test_against_brute_force(spark):
    names = known_names(spark)
    listed = [(r["pos"], r["inn"]) for r in names.orderBy("pos").collect()]
    rng = random.Random(1)
    words = {"paracetam", "paracetam0l", "ibuprofin", "metaprolol", "asprin", "metformine", "prednisone", "clavulanate amoxicillin", "zzzz"}
    for _, n in listed:
        i = rng.randrange(len(n))
        words |= {n[:i] + n[i + 1 :], n[:i] + "q" + n[i:], n}
    got = {r["token"]: (r["matched"], r["score"]) for r in M.match_tokens(spark.createDataFrame([(w,) for w in words], "token string"), names).collect()}
    for w in words:
        b = brute(w, listed)
        assert (b is None) == (w not in got), w
        if b:
            assert got[w][0] == b[1] and abs(got[w][1] - b[0]) <= 0.051, w


def test_no_match_record_and_blank(spark):
    rows = M.match_one(spark.createDataFrame([("  ",), (None,), ("Asprin",), ("xyzq",)], "input string"), known_names(spark), "list").collect()
    by = {r["input"]: r for r in rows}
    assert by["Asprin"]["matched"] == "aspirin" and by["Asprin"]["score"] == 92.3
    assert by["xyzq"]["source"] == "none" and not by["  "]["is_valid"] and None not in by


def test_tokens_first_occurrence(spark):
    df = spark.createDataFrame([("d", "Paracetam0l IBUPROFEN ibuprofen 500mg caffé باراسيتامول ٥٠٠٠ abc")], "doc_id string, text string")
    assert [r["input"] for r in M.document_tokens(df).orderBy("pos").collect()] == ["Paracetam", "IBUPROFEN", "caff", "باراسيتامول", "٥٠٠٠"]


def test_lists(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Aspirin,x\n\n  Ibuprofen ,y\n")
    (tmp_path / "a.json").write_text('["Aspirin", "", "B"]')
    assert [r["inn"] for r in load_names(spark, str(tmp_path / "a.csv")).orderBy("pos").collect()] == ["aspirin", "ibuprofen"]
    assert [r["inn"] for r in load_names(spark, str(tmp_path / "a.json")).orderBy("pos").collect()] == ["aspirin", "b"]
    assert load_names(spark, str(tmp_path / "none.csv")).first()["source"] == "fallback"


def test_long_names_and_quoted_lists(spark, tmp_path):
    long = "abcdefghij" * 6 + "kl"
    names = spark.createDataFrame([(0, long), (1, "abc")], "pos int, inn string")
    tokens = spark.createDataFrame([(long,), (long[:55],), (long[::-1],), ("abd",)], "token string")
    got = {r["token"]: (r["matched"], r["score"]) for r in M.match_tokens(tokens, names).collect()}
    assert got == {t: (b[1], round(b[0], 1)) for t in (long, long[:55], long[::-1], "abd") if (b := brute(t, [(0, long), (1, "abc")]))} and got[long] == (long, 100.0)
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert M.lcs_length(a, b) == lcs(a, b)
    (tmp_path / "q.csv").write_text('"Amoxicillin, Clavulanate",x\n"A ""b""",y\n')
    assert [r["inn"] for r in load_names(spark, str(tmp_path / "q.csv")).orderBy("pos").collect()] == ["amoxicillin, clavulanate", 'a "b"']


def test_substrings_against_brute_force(spark):
    rng = random.Random(4)
    some = lambda: "".join(rng.choice("abc ") for _ in range(rng.randint(1, 7)))
    names = [(k, some()) for k in range(60)] + [(99, "  "), (98, "")]
    tokens = {some() for _ in range(200)} | {""}
    got = {r["token"]: r["matched"] for r in M.match_substring(spark.createDataFrame([(t,) for t in tokens] + [(None,)], "token string"), spark.createDataFrame(names, "pos int, inn string")).collect()}
    want = {t: next((n for _, n in sorted(names) if n.strip() and (t in n or n in t)), None) for t in tokens if t}
    assert got == {t: n for t, n in want.items() if n is not None}
