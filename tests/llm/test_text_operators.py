import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliora.llm import bitext, boost, langid, leakage, lookalikes, names, packing, privacy, scannoise

EN = ["Do not drive if this medicine gives you headache.", "Tell your doctor at once if you notice fever or nausea.", "Store in the original box for no longer than six months.", "Swallow the dose with plenty of water and do not chew it."]
FR = ["Ne conduisez pas si ce médicament vous donne des nausées.", "Prévenez aussitôt votre médecin si vous remarquez de la fièvre.", "À garder dans la boîte d'origine pendant six mois au maximum.", "Avalez la dose avec beaucoup d'eau sans la croquer."]
DE = ["Fahren Sie nicht, wenn dieses Mittel bei Ihnen Schwindel auslöst.", "Informieren Sie sofort Ihren Arzt, wenn Sie Fieber bemerken.", "Nicht länger als sechs Monate im Kühlschrank lagern.", "Schlucken Sie die Dosis mit reichlich Wasser."]
AR = ["لا تقد السيارة إذا سبب لك هذا الدواء الصداع.", "أخبر طبيبك فورا إذا لاحظت الحمى أو الغثيان.", "يخزن في العلبة الأصلية لمدة لا تزيد على ستة أشهر.", "ابتلع الجرعة مع ماء كثير ولا تمضغها."]
FA = ["اگر این دارو در شما سردرد پدید می‌آورد رانندگی نکنید.", "اگر تب یا تهوع دیدید بی‌درنگ به پزشک خود بگویید.", "در جعبه اصلی و حداکثر تا شش ماه نگهداری شود.", "مقدار را با آب فراوان بخورید و نجوید."]


@pytest.fixture(scope="module")
def model():
    rows = [(t, g) for g, ts in (("en", EN), ("fr", FR), ("de", DE), ("ar", AR), ("fa", FA)) for t in ts for _ in range(3)]
    return langid.fit(pd.DataFrame(rows, columns=["text", "lang"]))


def test_languages(model):
    for g, ts in (("en", EN), ("fr", FR), ("de", DE), ("ar", AR), ("fa", FA)):
        assert [h for h, _ in model.classify([ts[0], ts[2]])] == [g, g]
    assert model.classify([]) == [] and model.classify(["", "12 34"]) == [(None, 0.0)] * 2
    s = langid.segments(EN[0] + " " + EN[1] + "\n" + AR[0] + "\n- 3 -", None, model)
    assert [x[2] for x in s] == ["en", "ar"] and langid.segments(None, None, model) == []


def test_far_sentences_are_rejected():
    """Sentences of languages without centroids are too far; held-out ones of known languages are not."""
    rng = random.Random(1)
    words = {g: sorted({w for s in ts for w in s.split()}) for g, ts in (("en", EN), ("fr", FR), ("de", DE))}
    made = [(" ".join(rng.choice(words[g]) for _ in range(11)), g) for g in words for _ in range(200)]
    m = langid.fit(pd.DataFrame(made[: 3 * 200], columns=["text", "lang"]).sort_values(["lang", "text"]).reset_index(drop=True))
    assert m.least and [g for g, _ in m.classify([f"{' '.join(rng.choice(words[g]) for _ in range(11))}" for g in ("en", "fr", "de") for _ in range(20)])] == ["en"] * 20 + ["fr"] * 20 + ["de"] * 20
    far = ["Nie stosować tego leku w ciąży ani podczas karmienia piersią wcale nigdy.", "Älä käytä tätä lääkettä jos olet raskaana tai imetät lasta koskaan ikinä."]
    assert [g for g, _ in m.classify(far)] == [None, None]


def test_label_cases(spark, model):
    schema = "region_key bigint, doc_id string, script string, lang string, text string, segments int"
    rows = [(1, "d", "latin", "EN-gb", EN[0], 1), (2, "d", None, "en", EN[1], 1), (3, "d", "latin", "fr", EN[0], 1), (4, "d", "mixed", "ar", AR[0] + " " + EN[2], 1), (5, "d", "x", "y", None, 1), (6, None, "latin", "en", "", 1), (2, "d", None, "en", EN[1], 1)]
    heads = spark.createDataFrame([("d", "Some 5 mg syrup, package leaflet")], "doc_id string, text string")
    got = {(r["region_key"], r["lang_found"]) for r in langid.label_cases(langid.identify(spark.createDataFrame(rows, schema), heads, model)).collect()}
    assert got == {(2, "en"), (3, "en"), (4, "ar"), (4, "en")}
    assert langid.identify(spark.createDataFrame([], schema), heads, model).count() == 0


def test_lookalikes(spark, model):
    assert lookalikes.plain("ｆｕｌｌ") == "full" and lookalikes.plain("сосо") == "coco"
    assert lookalikes.plain("é") == "é" and lookalikes.plain("ﬁ") == "fi" and lookalikes.plain("a​b") == "ab"
    odd = ["Take the dоse now, please do it.", "Take the dose now and rest.", "Take the do­se now and rest.", "لا تقد السیارة إذا سبب لك هذا الدواء الصداع.", "Do not use élite doses of it."]
    fine = ["The β2 receptor and the α-chain bind.", "Déjà vu à la crème brûlée.", AR[0], FA[0], FA[1], FA[2], None, "", "٣ mg"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(odd + fine + FA * 3)], "k int, text string, plain string").drop("plain")
    got = {r["k"]: r for r in lookalikes.unify(df, model).collect()}
    assert [got[k]["strange"] for k in range(len(odd))] == [True] * len(odd)
    assert [got[len(odd) + k]["strange"] for k in range(len(fine))] == [False] * len(fine)
    assert got[0]["plain"] == "Take the dose now, please do it." and got[3]["plain"] == AR[0]
    assert lookalikes.unify(df.limit(0), model).count() == 0


def test_lookalikes_found_by_rewriting(spark, model):
    odd = ["Take ℓ of the dose now, please.", "Take the doℎe now, please do it.", "The ℹnfo on the dose is here.", "The 𞸀 is here.", "Take the dose.​ Do it now.", "Take the αose now, please."]
    fine = ["Take 5 µg of the dose now.", "The α-chain of it binds.", "The name is علي or على or علی here."]
    got = {r["k"]: r for r in lookalikes.unify(spark.createDataFrame(list(enumerate(odd + fine + ["Take the dose now."])), "k int, text string"), model).collect()}
    assert [got[k]["strange"] for k in range(len(odd) + len(fine))] == [True] * len(odd) + [False] * len(fine)
    assert got[0]["plain"] == "Take l of the dose now, please." and got[len(odd) + 1]["plain"] == fine[1]


def test_stray_joiners(spark, model):
    forms = {"می‌شود": (1, 0), "چا‌پ": (5, 68), "چاپ‌": (9, 0), "چاپ‌شده": (4, 0), "اپ‌شده": (1, 0), "جلی‌تیس": (2, 0)}
    joined = spark.createDataFrame([(f, n, m) for f, (n, m) in forms.items()], "form string, n bigint, m bigint")
    assert {r["form"] for r in lookalikes.proper_joined(joined).collect()} == {"می‌شود", "چاپ‌شده", "اپ‌شده"}
    stray = "اگر تب یا تهوع دیدید به پز‌شک خود بگویید."
    rows = [stray] * 5 + ["اگر تب یا تهوع دیدید به پزشک خود بگویید.", "مقدار را با آب‌ فراوان بخورید و نجوید.", *FA]
    got = {r["k"]: r for r in lookalikes.unify(spark.createDataFrame(list(enumerate(rows)), "k int, text string"), model).collect()}
    assert [got[k]["strange"] for k in range(len(rows))] == [True] * 5 + [False, True] + [False] * len(FA)
    assert got[0]["plain"] == rows[5]
    many = {r["k"]: (r["strange"], r["plain"]) for r in lookalikes.unify(spark.createDataFrame(list(enumerate(rows)), "k int, text string"), model, most_forms=0).collect()}
    assert many == {k: (r["strange"], r["plain"]) for k, r in got.items()}  # the joined spellings joined to each text instead of held


LIST = ["paracetol", "ibuprofex", "metformine", "aspirol metformine", "zopiclonax"]


def test_names(spark):
    entries = spark.createDataFrame(list(enumerate(LIST)), "pos int, inn string")
    rows = ["Paracet0l 500 mg", "ibuprofx", "METFORMINE + ASPIROL", "metformine sodium", "zopic lonax", "zopiclo.", names.transcribe("ibuprofex"), "sugar", "", "  ", None, "x" * 20_000, "paracetol", "paracetol"]
    df = spark.createDataFrame([(t, -1.0) for t in rows], "input string, score double")
    got = {r["input"]: r["pos"] for r in names.match_names(df, entries).collect()}
    assert got == {rows[0]: 0, rows[1]: 1, rows[2]: 3, rows[3]: 2, rows[4]: 4, rows[5]: 4, rows[6]: 1, "sugar": -1, "x" * 20_000: -1, "paracetol": 0}
    assert {r["pos"] for r in names.match_names(df, entries.limit(0)).collect()} == {-1}


def test_names_in_many_pieces(spark):
    entries = spark.createDataFrame(list(enumerate(LIST)) + [(9, "zinc")], "pos int, inn string")
    df = spark.createDataFrame([("p a r a c e t o l",), ("ibu pro fe x 5 mg",), ("zinc",), ("zin",)], "input string")
    assert {r["input"]: r["pos"] for r in names.match_names(df, entries).collect()} == {"p a r a c e t o l": 0, "ibu pro fe x 5 mg": 1, "zinc": 9, "zin": 9}


def test_segment_join_finds_all_within_edits():
    rng = random.Random(2)
    for _ in range(400):
        w = "".join(rng.choice("abcde") for _ in range(rng.randint(4, 14)))
        t = list(w)
        for _ in range(rng.randint(0, names.edits(len(w)))):
            i = rng.randrange(len(t)) if t else 0
            rng.choice([lambda: t.insert(i, rng.choice("abcde")), lambda: t.pop(i) if len(t) > 1 else None, lambda: t.__setitem__(i, rng.choice("abcde"))])()
        assert set(names.segment_keys(w)) & set(names.probe_keys("".join(t))), (w, "".join(t))


def test_bitext(spark):
    n = [("Keep Zoloprix at 5 degrees for 12 days.", "احفظ زولوبريكس عند ٥ درجات لمدة ١٢ يوما."), ("Take 7 tablets of Mirtazol in 30 hours.", "تناول ٧ أقراص من ميرتازول خلال ٣٠ ساعة."), ("The label shows code T123 and 8 units.", "يظهر الملصق الرمز T123 و 8 وحدة.")]
    docs = [(k, " ".join(a for a, _ in n), " ".join(b for _, b in (n if k % 2 else n[::-1]))) for k in range(8)] + [(90, None, "x."), (91, "", ""), (92, "A.", None)]
    got = bitext.align_sentences(spark.createDataFrame(docs, "key bigint, en string, ar string")).collect()
    assert {(r["en_sent"], r["ar_sent"]) for r in got if r["key"] == 1} == {(1, 1), (2, 2), (3, 3)}
    assert {(r["en_sent"], r["ar_sent"]) for r in got if r["key"] == 2} == {(1, 3), (2, 2), (3, 1)}
    assert not [r for r in got if r["key"] >= 90]
    assert bitext.sentences("A b. C?\nD 2.5 e.") == ["A b.", "C?", "D 2.5 e."] and bitext.sentences(None) == []
    assert bitext.align_sentences(spark.createDataFrame([], "key bigint, en string, ar string")).count() == 0
    df = spark.createDataFrame(docs, "key bigint, en string, ar string")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(bitext.align_sentences(df, most_entries=0)) == rows(bitext.align_sentences(df))  # the lexicon joined instead of held


def brute_increasing(pairs):
    best = []
    for k, (_, j) in enumerate(pairs):
        best.append(1 + max([best[h] for h in range(k) if pairs[h][1] < j], default=0))
    return max(best, default=0)


def test_increasing_chain_and_linear_work():
    rng = random.Random(2)
    for _ in range(100):
        pairs = [(i, rng.randrange(12)) for i in range(rng.randint(0, 12))]
        got = bitext.increasing(pairs)
        assert len(got) == brute_increasing(pairs) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:]))
    words = "take store drink keep dose water food bottle fever morning night child doctor ask stop use never always before after".split()
    lex = bitext.Lexicon((w, "ع" + w, 0.8) for w in words)
    pairs_of = []
    for n in (400, 800):
        own = [[rng.choice(words) for _ in range(8)] for _ in range(n)]
        en, ar = bitext.Side(" ".join(f"{' '.join(w)} {k}." for k, w in enumerate(own))), bitext.Side(" ".join(f"{' '.join('ع' + x for x in w)} {k}." for k, w in enumerate(own)))
        pairs_of.append(len(bitext.Scores(en, ar, lex).known))
    assert pairs_of[1] <= 2.2 * pairs_of[0]


def brute_anchors(e, a):
    df = {k: sum(k in x for x in [*e, *a]) for x in [*e, *a] for k in x}
    total = [sum(1 / df[k] for k in x) for x in [*e, *a]]
    score = [[2 * sum(1 / df[k] for k in x & y) / (total[i] + total[len(e) + j]) if x & y else 0.0 for j, y in enumerate(a)] for i, x in enumerate(e)]
    out = []
    for i, x in enumerate(e):
        if x and (len(x) > 1 or all(df[k] == 2 for k in x)):
            v = max(score[i])
            j = score[i].index(v)
            if v >= 0.9 and sum(o >= v - 0.1 for o in score[i]) == 1 and sum(row[j] >= v - 0.1 for row in score) == 1:
                out.append((i, j))
    return out


def test_frequent_anchors_pair_sentences():
    # each number stands in nine sentences of both sides, each two numbers in one
    own = [{f"{x}", f"{10 + y}"} for x in range(9) for y in range(9)]
    assert bitext.by_anchors(own, own[::-1]) == [(i, 80 - i) for i in range(81)]
    rng = random.Random(5)
    for n, letters in [(8, "abc"), (30, "abcdef"), (150, "abcdefgh")] * 10:
        e, a = [[{c for c in letters if rng.random() < 0.4} | ({f"{i}"} if rng.random() < 0.2 else set()) for i in range(n)] for _ in range(2)]
        a[: n // 2] = rng.sample(e, n // 2)
        assert bitext.by_anchors(e, a) == brute_anchors(e, a)


def brute_scores(en, ar, lex):
    e, a, names = bitext.anchors(en, ar)
    arabic = set().union(*names.values()) if names else set()
    to = lambda w, v: lex.to.get(w, {}).get(v, 0.0)
    out = {}
    for i in range(len(en)):
        for j in range(len(ar)):
            we, wa, k = en.words[i] - names.keys(), ar.words[j] - arabic, 3.0 * len(e[i] & a[j])
            te = sum(lex.best_en.get(w, 0.3) for w in we) + 3.0 * len(e[i])
            ta = sum(lex.best_ar.get(v, 0.3) for v in wa) + 3.0 * len(a[j])
            out[i, j] = ((sum(max((to(w, v) for v in ar.words[j]), default=0.0) for w in we) + k) / (te or 1.0), (sum(max((to(w, v) for w in en.words[i]), default=0.0) for v in wa) + k) / (ta or 1.0))
    return out


def brute_gap(p, q, all_of, off):
    best = [[0.0] * (q + 1) for _ in range(p + 1)]
    for x in range(p + 1):
        for y in range(q + 1):
            options = [best[x - 1][y]] * (x > 0) + [best[x][y - 1]] * (y > 0) + [0.0]
            if x and y:
                ce, ca = all_of[x - 1, y - 1]
                o = off(x - 1, y - 1)
                if math.sqrt(ce * ca) >= bitext.GAP:
                    options.append(best[x - 1][y - 1] + math.sqrt(ce * ca) - o)
                if y > 1 and min(ca, all_of[x - 1, y - 2][1]) >= bitext.CONTAINED:
                    options.append(best[x - 1][y - 2] + ca + all_of[x - 1, y - 2][1] - o - off(x - 1, y - 2))
                if x > 1 and min(ce, all_of[x - 2, y - 1][0]) >= bitext.CONTAINED:
                    options.append(best[x - 2][y - 1] + ce + all_of[x - 2, y - 1][0] - o - off(x - 2, y - 1))
            best[x][y] = max(options)
    return best[p][q]


def gain(pairs, all_of, off):
    """What an alignment is worth by the rules of its beads."""
    total, pairs = 0.0, sorted(pairs)
    while pairs:
        (i, j), *rest = pairs
        two = next((p for p in rest if (p[0] == i) != (p[1] == j)), None)
        if two:
            side = 1 if two[0] == i else 0
            assert abs(two[0] - i) + abs(two[1] - j) == 1 and min(all_of[i, j][side], all_of[two][side]) >= bitext.CONTAINED
            total += all_of[i, j][side] + all_of[two][side] - off(i, j) - off(*two)
            rest.remove(two)
        else:
            total += math.sqrt(math.prod(all_of[i, j])) - off(i, j)
        assert all(p[0] > max(i, two[0] if two else i) and p[1] > max(j, two[1] if two else j) for p in rest)
        pairs = rest
    return total


def test_every_pair_of_clauses_counts():
    rng = random.Random(8)
    words = "take store drink keep dose water food bottle fever morning night child doctor ask stop use".split()
    entries = [(w, "ع" + w, round(rng.uniform(0.4, 1), 2)) for w in words[:-3]] + [(w, "ع" + v, 0.2) for w, v in zip(words, words[1:])]
    lex = bitext.Lexicon(entries)
    for n, m, few in [(5, 7, 64), (14, 12, 64), (14, 12, 3), (90, 80, 64), (80, 95, 64)] * 4:
        # few words, so that all of them are frequent, and few numbers
        own = [rng.sample(words, rng.randint(3, 8)) + [str(rng.randrange(4))] * (rng.random() < 0.3) for _ in range(n)]
        there = [[w if w.isdigit() else "ع" + w for w in (rng.choice(own) if rng.random() < 0.8 else rng.sample(words, 5)) if rng.random() < 0.85] or ["ع"] for _ in range(m)]
        en, ar = bitext.Side(" ".join(f"{' '.join(w)}." for w in own)), bitext.Side(" ".join(f"{' '.join(w)}." for w in there))
        all_of = brute_scores(en, ar, lex)
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(bitext, "SHORT", few)
            scores = bitext.Scores(en, ar, lex)
            off, best = scores.off, {k: math.sqrt(x * y) for k, (x, y) in all_of.items()}
            for i in range(len(en)):
                _, j = max((round(best[i, j] - off(i, j), 9), -j) for j in range(len(ar)))
                assert scores.best_e[i] == (-j if best[i, -j] >= bitext.SURE else None)
                for least in (0.3, 0.5, 0.6):
                    assert scores.e.reach(i, least) == pytest.approx({j: all_of[i, j][0] for j in range(len(ar)) if all_of[i, j][0] >= least - 1e-9})
            for j in range(len(ar)):
                _, i = max((round(best[i, j] - off(i, j), 9), -i) for i in range(len(en)))
                assert scores.best_a[j] == (-i if best[-i, j] >= bitext.SURE else None)
                assert scores.a.reach(j, 0.5) == pytest.approx({i: all_of[i, j][1] for i in range(len(en)) if all_of[i, j][1] >= 0.5 - 1e-9})
            pairs = bitext._gap(list(range(len(en))), list(range(len(ar))), scores)
            assert gain(pairs, all_of, off) == pytest.approx(brute_gap(len(en), len(ar), all_of, off))


def test_pairs_far_from_the_diagonal_and_of_frequent_words():
    words = [f"{a}{b}on" for a in "bdfgklmnprst" for b in "aeiou"]
    lex = bitext.Lexicon((w, "ع" + w, 0.8) for w in words)
    # two thirds of each clause are known to the lexicon: too little for a sure pair or a merged one; 60 unknown clauses on one side stand before, on the other after
    part = [f"{words[k]} {words[k + 1]} {words[k + 2]} x" for k in range(0, 57, 3)]
    odd = [f"qq{k:03d}".translate(str.maketrans("0123456789", "abcdefghij")) for k in range(60)]
    en = ". ".join([*(f"{p} unseen{'a' * (k + 1)} uncommon{'b' * (k + 1)} unheard{'c' * (k + 1)} unasked{'d' * (k + 1)}" for k, p in enumerate(part)), *odd]) + "."
    ar = ". ".join([*odd[::-1], *(" ".join("ع" + w for w in p.split()[:3]) + f" ظظ{'ض' * (k + 1)} صص{'ض' * (k + 1)} طط{'ض' * (k + 1)} قق{'ض' * (k + 1)} كك{'ض' * (k + 1)}" for k, p in enumerate(part))]) + "."
    got = bitext.align(en, ar, lex)
    assert {(k + 1, 61 + k) for k in range(len(part))} <= set(got)
    # sixteen words, each in a quarter of the clauses; a clause is told by its four
    own = [[words[15 * k + x] for k, x in enumerate(xs)] for xs in itertools.product(range(4), repeat=4)]
    rng = random.Random(3)
    order = rng.sample(range(256), 256)
    got = bitext.align(" ".join(f"{' '.join(w)}." for w in own), " ".join(f"{' '.join('ع' + w for w in own[k])}." for k in order), lex)
    assert got == sorted((k + 1, at + 1) for at, k in enumerate(order))


def test_scan_noise_parts():
    words, cuts = scannoise.tokens_of("The medi- \n3/4\ncine is long-term.\n- 2 -\nα-\nchain")
    assert (0, 2, "medi", "cine", 0, 1) in cuts and "long-term" in words and "medi" not in words and "cine" not in words
    assert scannoise.tokens_of("a medi－\ncine")[1] == [(0, 1, "medi", "cine", 0, 0)]
    assert scannoise.repaired("u5ually", "usually") == 1 and scannoise.repaired("openecl", "opened") == 1 and scannoise.repaired("abc", "xyz") is None
    assert scannoise._odd_word("diabe+es") and not scannoise._odd_word("CYP3A4") and not scannoise._odd_word("T73160") and not scannoise._odd_word("B12")
    assert "diabetes" in scannoise.undone("diabe+es", True) and "the" in scannoise.undone("tbe", False)


def test_mend():
    text = "1. Use\nTake the medi- \nZolo 5 mg\ncine with u5ual\n- 2 -\nfood.\n\nThe α-\nchain of it."
    edits = [{"noise": "hyphen", "line": 1, "a": "medi", "b": "cine"}, {"noise": "header", "line": 2, "a": "", "b": ""}, {"noise": "char", "line": 0, "a": "u5ual", "b": "usual"}, {"noise": "page_number", "line": 4, "a": "", "b": ""}]
    assert scannoise.mend(text, edits) == "1. Use\n\nTake the medicine with usual food.\n\nThe α-chain of it."
    assert scannoise.mend("", []) == ""


def test_scan_noise(spark):
    rng = random.Random(5)
    base = ["usually", "medicine", "doctor", "hospital", "patient", "headache", "morning", "evening", "children", "tablets", "follow-up", "long-term"]
    reg = [(f"d{k % 30}", "text_block", " ".join(rng.choice(base) for _ in range(12)) + ".") for k in range(150)]
    reg += [(f"d{k}", "header", "Zoloprix 5 mg syrup, package leaflet") for k in range(30)] + [(f"d{k}", "footer", t) for k in range(30) for t in (f"- {k} -", f"Page {k} of 40")]
    texts = [("r", 1, "d1", "the medi-\ncine is here."), ("r", 2, "d1", "it is u5ually so."), ("r", 3, "d1", "words\nZoloprix 5 mg syrup, package leaflet\nmore words here."), ("r", 4, "d1", "words\n- 3 -\nmore words."), ("r", 5, "d1", "a follow-\nup with the doctor."), ("r", 6, "d1", None), ("r", 7, "d1", ""), ("r", 8, "d1", "B12 and CYP3A4 for the patient."), ("r", 1, "d1", "the medi-\ncine is here.")]
    got = {(r["row_key"], r["noise"]) for r in scannoise.find_edits(spark.createDataFrame(texts, "src string, row_key bigint, doc_id string, text string"), spark.createDataFrame(reg, "doc_id string, region_type string, text string")).collect()}
    assert {(1, "hyphen"), (2, "char"), (3, "header"), (4, "page_number")} <= got and not {k for k, _ in got} & {5, 6, 7, 8}
    df = spark.createDataFrame([(*r, "x") for r in texts], "src string, row_key bigint, doc_id string, text string, repaired string")
    fixed = {r["row_key"]: r["repaired"] for r in scannoise.repair_texts(df, spark.createDataFrame(reg, "doc_id string, region_type string, text string")).collect()}
    assert fixed[1] == "the medicine is here." and fixed[2] == "it is usually so." and fixed[3] == "words more words here." and fixed[4] == "words more words." and fixed[5] == "a follow-up with the doctor." and fixed[6] is None and fixed[7] == ""
    assert scannoise.find_edits(df.limit(0), spark.createDataFrame(reg, "doc_id string, region_type string, text string").limit(0)).count() == 0


def word_table(spark, rows):
    return spark.createDataFrame([(w, n, n, int(scannoise._odd_word(w))) for w, n in rows], "word string, n bigint, copies bigint, odd bigint")


def test_recall_of_candidates(spark):
    """Of words misread up to three times, the right word is among the candidates."""
    rng = random.Random(9)
    syllables = ["me", "di", "ta", "ral", "on", "ste", "ni", "cor", "bu", "lin", "hea", "ter", "mo", "gra"]
    words = sorted({"".join(rng.choice(syllables) for _ in range(rng.randint(2, 5))) for _ in range(600)})
    made = {scannoise.misread(w, rng, 1 + k % 3): w for k, w in enumerate(words)}
    bad = {b: w for b, w in made.items() if b not in words and len(b) >= 4}
    pairs = {(r["word"], r["target"]) for r in scannoise.candidate_pairs(word_table(spark, [(w, 40) for w in words] + [(b, 1) for b in bad])).collect()}
    assert sum((b, w) in pairs for b, w in bad.items()) >= 0.95 * len(bad)


USUAL = [(w, 60 + k) for k, w in enumerate("usually medicine doctor hospital patient headache morning evening children tablets combination amount section before number".split())]


def test_misread_word_in_many_copies(spark):
    texts = ["the doctor said usually or before.", *[f"usually the number {w} comes before." for w, _ in USUAL]] + ["it is usiially so."] * 20
    counts = scannoise.word_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    got = {r["word"]: (r["n"], r["copies"]) for r in counts.collect()}
    assert got["usiially"] == (1, 20) and got["usually"][0] == 17
    found = scannoise.find_misread(counts.filter("word = 'usiially'").unionByName(word_table(spark, USUAL))).collect()
    assert ("usiially", "usually") in {(r["word"], r["replacement"]) for r in found}


def test_misread_word_whose_rarest_trigrams_are_damaged(spark):
    decoys = [(w, 90) for w in "corx xorn xrnb xnbi xbir xiri xria xiat nation station ration cotion relation action cobalt coat cosy comet condition".split()]
    found = scannoise.find_misread(word_table(spark, USUAL + decoys + [("cornbiriation", 1)])).collect()
    assert ("cornbiriation", "combination") in {(r["word"], r["replacement"]) for r in found}


def brute_fill(lengths, room):
    best = {0}
    for n in lengths:
        best |= {b + n for b in best if b + n <= room}
    return max(best)


def test_fill_is_optimal_and_pack_is_whole():
    rng = random.Random(3)
    for _ in range(200):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(0, 12))]
        counts = {n: lengths.count(n) for n in lengths}
        room = rng.randint(0, 80)
        got = packing.fill(counts, room)
        assert sum(n * k for n, k in got.items()) == brute_fill(lengths, room) and all(k <= counts[n] for n, k in got.items())
    lengths = [rng.randint(1, 100) for _ in range(500)]
    boxes = packing.pack(lengths, 100)
    assert sorted(k for b in boxes for k in b) == list(range(500)) and all(sum(lengths[k] for k in b) <= 100 for b in boxes)
    assert len(boxes) <= sum(lengths) / 100 * 1.03 + 1


def test_pack_documents(spark):
    docs = spark.createDataFrame([(1, 250), (2, 50), (3, 0), (4, None), (5, 50), (5, 50), (None, 3)], "doc_id bigint, n_tokens bigint")
    limits = spark.createDataFrame([(1, 100), (2, None), (3, 0), (None, 5)], "limit_id int, capacity_tokens int")
    rows = packing.pack_documents(docs, limits).collect()
    assert {r["limit_id"] for r in rows} == {1} and sum(r["n_tokens"] for r in rows) == 400
    assert sorted((r["first_token"], r["n_tokens"]) for r in rows if r["doc_id"] == 1) == [(0, 100), (100, 100), (200, 50)]
    use = {}
    for r in rows:
        use[r["container"]] = use.get(r["container"], 0) + r["n_tokens"]
    assert max(use.values()) <= 100 and len([u for u in use.values() if u]) == 4
    many = spark.createDataFrame([(k, 100) for k in range(packing.LIMITS_A_PASS + 5)], "limit_id int, capacity_tokens int")
    assert {r["count"] for r in packing.pack_documents(docs.limit(1), many).groupBy("limit_id").count().collect()} == {3}
    assert packing.pack_documents(docs.limit(0), limits).count() == 0 and packing.pack_documents(docs, limits.limit(0)).count() == 0


def test_leakage(spark):
    rng = random.Random(4)
    vocab = [f"w{k}x" for k in range(3000)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(90))) for k in range(20)]
    filler = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    words = items[3][1].split()
    noisy = [w for k, w in enumerate(words[20:60]) if k % 11 != 5]
    docs = [(1, filler(400) + " " + " ".join(words[10:50]).upper() + ", " + filler(300)), (2, filler(200) + " " + " ".join(noisy) + " " + filler(50)), (3, filler(100) + " " + " ".join(words[:12]) + " " + filler(100)), (4, None), (5, ""), (6, filler(500)), (7, items[7][1].replace(" ", "\n"))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    it = spark.createDataFrame(items + [(99, None), (98, "")], "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaked_items(d, it).collect()} == {(1, 3), (2, 3), (7, 7)}
    assert leakage.leaked_items(d, it.limit(0)).count() == 0 and leakage.leaked_items(d.limit(0), it).count() == 0


def test_leakage_limits(spark):
    """Many items, copies just under and at the least length, and noisy ones near it; extra columns are ignored."""
    rng = random.Random(8)
    vocab = [f"v{k}q" for k in range(4000)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [some(rng.randint(40, 80)) for _ in range(2000)]
    docs, want = [], set()
    for k in range(150):
        item = rng.randrange(len(items))
        n = (22, 23, 24, 25, 26, 30)[k % 6]
        docs.append((k, some(rng.randint(0, 900)) + items[item][5 : 5 + n] + some(rng.randint(0, 200))))
        if n >= 25:
            want.add((k, item))
    noisy = set()
    for k in range(200, 350):
        item = rng.randrange(len(items))
        words = items[item][3 : 3 + rng.randint(30, 37)]
        for at in sorted(rng.sample(range(2, len(words) - 2), 3), reverse=True):
            words[at : at + 1] = rng.choice([[], [rng.choice(vocab)], [words[at], rng.choice(vocab)]])
        docs.append((k, some(rng.randint(0, 300)) + words + some(rng.randint(0, 100))))
        noisy.add((k, item))
    d = spark.createDataFrame([(k, " ".join(w), "x", k) for k, w in docs], "doc_id bigint, text string, words string, item_id int")
    it = spark.createDataFrame([(k, " ".join(w), 1) for k, w in enumerate(items)], "item_id bigint, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked_items(d, it).collect()}
    assert {p for p in got if p[0] < 200} == want
    assert len(noisy & got) >= 0.97 * len(noisy) and not {p for p in got if p[0] >= 200} - noisy


def test_boost():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = boost.Boosted().fit(x[:1500], y[:1500])
    assert ((m.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95 and len(m.predict(np.zeros((0, 4)))) == 0


def test_privacy(spark):
    rng = random.Random(6)
    first, last = ["Orvia", "Tovald", "Minaree", "Havelor"], ["Halstow", "Quarmere", "Lorlund", "Sundren"]
    docs = []
    for k in range(400):
        a, n = f"{rng.choice(first)} {rng.choice(last)}", rng.randint(100, 199)
        docs += [f"The reaction was reported by {a}, reachable on 0{n % 90 + 10} 555 0{n}. Lot QQ-{n}91-71 expires 2034-07.", f"National ID: {n}01-2345-{n}7; carer {a}. Article code 1{n}-1{n}-582, shelf 59.", f"Passport no. JM-{n}32-90, home address {n} Quenst Lane, 91333 Pedralva.", f"Please send the reply to a.b{n}@post.example before the visit. Velmor Forte and Duskan Retard share the same shelf."]
    f = privacy.Finder().fit(docs)
    t = "The reaction was reported by Orvia Lorlund, reachable on 055 555 0123. National ID: 12301-2345-1237; carer Tovald Sundren. Lot QQ-12391-71 expires 2034-07."
    (spans,) = f.find([t])
    assert {(k, t[a:z]) for k, a, z, _ in spans} == {("name", "Orvia Lorlund"), ("phone", "055 555 0123"), ("id_number", "12301-2345-1237"), ("name", "Tovald Sundren")}
    assert privacy.redact(t, spans).startswith("The reaction was reported by [NAME], reachable on [PHONE].")
    df = spark.createDataFrame([(1, t, 5), (2, None, 5), (3, "", 5), (1, t, 5)], "doc_id bigint, text string, spans int")
    rows = {r["doc_id"]: r for r in privacy.redactions(df, f).collect()}
    assert len(rows[1]["spans"]) == 4 and rows[2]["redacted"] is None and rows[3]["redacted"] == ""
    assert privacy.redactions(df.limit(0), f).count() == 0


def test_privacy_without_cues():
    """Held-out sentences with none of the cue words: names of known words in new combinations, numbers of a known shape, and look-alikes that are no details."""
    rng = random.Random(16)
    first = ["Orvia", "Tovald", "Minaree", "Havelor", "Selphine", "Brennoc", "Zerlina", "Quenla"]
    last = ["Halstow", "Quarmere", "Lorlund", "Sundren", "Pemosa", "Wickard", "Fenusk", "Talridge"]
    docs = []
    for k in range(900):
        a, n = f"{rng.choice(first)} {rng.choice(last)}", rng.randint(100, 199)
        docs += [f"The reaction was reported by {a}, reachable on 0{n % 90 + 10} 555 0{n}. Lot QQ-{n}91-71 expires 2034-07.", f"National ID: {n}01-2345-{n}7; carer {a}. Article code 1{n}-1{n}-582 is new.", f"Passport no. JM-{n}32-90, home address {n} Quenst Lane, 91333 Pedralva.", f"Please send the reply to a.b{n}@post.example before the visit. Velmor Forte and Duskan Retard share the same box.", "Keep Velmor Forte in a dry place. Doses of 500-1000-1500 mg were compared. Meet us @ the desk of ward 7, Store Below 30."]
    f = privacy.Finder().fit(docs)
    assert all(len(f.models[k][0].flat) and any(len(tree[0]) > 1 for tree in f.models[k][0].flat) for k in privacy.KINDS)
    found = total = 0
    for k in range(200):
        a, n = f"{rng.choice(first)} {rng.choice(last)}", rng.randint(100, 199)
        parts = [("Yesterday ", None), (a, "name"), (" visited the shop and left ", None), (f"0{n % 90 + 10} 555 0{n}", "phone"), (" behind, or ", None), (f"x.y{n}@mail.example", "email"), (" at ", None), (f"{n} Orbell Street", "address"), (". Keep Velmor Forte in it. Doses of 500-1000-1500 mg.", None)]
        text, want, at = "", set(), 0
        for s, kind in parts:
            if kind:
                want.add((kind, len(text), len(text) + len(s)))
            text += s
        (got,) = f.find([text])
        got = {s[:3] for s in got}
        found += len(want & got)
        total += len(want)
        assert got <= want, (text, got - want)
    assert found >= 0.9 * total


def test_words_of_names_from_all_documents(spark):
    cued = [f"وصل اليوم {k} تقرير عن المريضة سلوان خالدي صباحا." for k in range(3)]
    docs = spark.createDataFrame([(t,) for t in cued + ["عن المريضة نادر خالدي."] * 5 + ["a text", None]], "text string")
    assert {(r["word"], r["place"]) for r in privacy.cued_words(docs).collect()} == {("سلوان", 1), ("خالدي", 2)}
    finder = privacy.fitted(docs, most=0)
    later = "وقد زار سلوان خالدي الصيدلية ثم سمير خالدي"
    assert {"سلوان خالدي", "سمير خالدي"} <= {later[a:z] for k, a, z in privacy.candidates(later, finder.knows) if k == "name"}
    assert finder.find([None, "", later]) == [[], [], []]
    copies = spark.createDataFrame([("Dr. a 1234",)] * 50 + [(f"Dr. {k} 1234",) for k in range(5)], "text string")
    assert len(privacy.training_texts(copies, 100)) == 6
