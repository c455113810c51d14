import random

import numpy as np
from pyspark.sql import functions as F

from seqprep.llm import op02_language as o2

WORDS = {"en": "the and of with house which through something water".split(), "de": "der und mit nicht über schön wasser durch straße".split(), "fr": "le et avec où déjà maison être eau à travers".split()}


def make(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_fusion(spark):
    rows = []
    for k in range(150):
        lang = "en de fr".split()[k % 3]
        rows.append((k, f"http://{lang}.example.{lang}/{lang}/x", f"<html lang='{lang}-XX'><body><article><p>{make(lang, 40, k)}</p></article></body></html>"))
    rows.append((900, "http://de.example.de/de/1", "<html lang='en'><article><p>" + make("de", 60, 1) + "</p></article></html>"))  # wrong label
    rows.append((901, "http://de.example.de/de/2", "<html><p>ok</p></html>"))  # no text evidence to speak of
    rows.append((902, None, None))
    rows.append((None, "", "<html lang=en><p>" + make("en", 30, 2) + "</p></html>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: r for r in o2.language_id(df, "page_id", "html", url="url", html=True).collect()}
    assert all(got[k].lang == "en de fr".split()[k % 3] and got[k].kept for k in range(150))
    assert got[900].lang == "de" and got[900].declared == "en" and not got[900].kept
    assert got[901].lang == "de"  # host and suffix decide
    assert got[902].n_trigrams == 0 and not got[902].kept
    assert got[None].lang == "en" and got[None].kept
    assert all(0 < r.prob <= 1 for r in got.values())


def test_documents(spark):
    docs = [(k, make("en de fr".split()[k % 3], 30, k), "en de fr".split()[k % 3], f"s{k % 4}", 9) for k in range(90)]
    docs += [(500, "", "en", "s1", 0), (500, "12 34 %%", None, None, 0), (None, make("en", 30, 7), None, None, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    kept = o2.keep_identified(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*range(90), None], key=str)
    assert o2.keep_identified(df.limit(0)).collect() == []


def test_held_out_accuracy(spark):
    """A fifth of the pages without their label: text, host and suffix must find it; their labels neither train nor count."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bare = F.when(F.col("page_id") % 5 == 0, F.regexp_replace("html", r"<html lang=\"[a-z]+\">", "<html>")).otherwise(F.col("html"))
    truth = {r.page_id: r.lang for r in pages.select("page_id", F.regexp_extract("html", r"<html lang=\"([a-z]+)\">", 1).alias("lang")).collect()}
    got = [r for r in o2.language_id(pages.withColumn("html", bare), "page_id", "html", url="url", html=True).collect() if r.id % 5 == 0]
    assert len(got) >= 40 and all(r.declared is None for r in got)
    assert sum(r.text_lang == truth[r.id] for r in got) / len(got) > 0.93
    assert sum(r.lang == truth[r.id] for r in got) / len(got) > 0.96


def brute(rows):
    """Posterior of each language by plain sums: rows of (text, declared, host)."""
    import math

    def cells(text):
        x = bytes(c if o2._LETTER[c] else 32 for c in (text or "").lower().encode())
        return [(((x[i] << 16 | x[i + 1] << 8 | x[i + 2]) * 0x9E3779B97F4A7C15) % 2**64) >> 51 for i in range(len(x) - 2) if sum(c != 32 for c in x[i : i + 3]) >= 2]

    found = [cells(t) for t, _, _ in rows]
    number = {}
    for _, d, _ in rows:
        number[d] = number.get(d, 0) + 1
    names = sorted(d for d, n in number.items() if d and n >= o2.LEAST)
    if any(d and n < o2.LEAST for d, n in number.items()):
        names.append(o2.OTHER)
    own = [d and (d if d in names else o2.OTHER) for _, d, _ in rows]
    count = {x: {} for x in names}
    for c, o in zip(found, own, strict=True):
        for k in c if o else ():
            count[o][k] = count[o].get(k, 0) + 1
    mass = {x: sum(c.values()) for x, c in count.items()}
    even = lambda k: sum(c.get(k, 0) for c in count.values()) / sum(mass.values())
    log = lambda x, k: float(np.float32(math.log((count[x].get(k, 0) + 50 * even(k) + 1e-3) / (mass[x] + 50 + 1e-3 * o2.BUCKETS))))
    like = [[sum(log(x, k) for k in c) * min(len(c), o2.TRIGRAMS) / max(len(c), 1) for x in names] for c in found]
    guess = [m.index(max(m)) if c else None for m, c in zip(like, found, strict=True)]

    def shares(of, above):
        n = [sum(g == k for g, o in zip(guess, of, strict=True) if o) for k in range(len(names))]
        return [(n[k] + o2.STRENGTH * above[k]) / (sum(n) + o2.STRENGTH) for k in range(len(names))]

    prior = shares([True] * len(rows), [1 / len(names)] * len(names))
    out = []
    for k, (_, d, h) in enumerate(rows):
        domain = None if h is None else ".".join(h.split(".")[-2:])
        by_domain = shares([(None if x[2] is None else ".".join(x[2].split(".")[-2:])) == domain for x in rows], prior)
        by_host = shares([x[2] == h for x in rows], by_domain)
        suffix = lambda x: x.rsplit(".", 1)[1] if x and "." in x else ""
        by_suffix = shares([suffix(x[2]) == suffix(h) and (x[2] is None) == (h is None) for x in rows], prior)
        by_label = shares([x[1] == d for x in rows], prior) if d else prior
        logs = [like[k][i] + math.log(by_host[i]) + math.log(by_label[i] / prior[i]) + (math.log(by_suffix[i] / prior[i])) for i in range(len(names))]
        top = max(logs)
        out.append((names[logs.index(top)], 1 / sum(math.exp(x - top) for x in logs)))
    return out


def test_posterior_equals_brute_force(spark):
    rows = []
    for k in range(60):
        lang = "en de fr".split()[k % 3]
        text = make(lang, 1 + k % 7, k) + (" " + make("en", k % 5, k) if k % 4 == 0 else "")
        rows.append((text if k % 11 else "", None if k % 6 == 5 else ("de" if k % 13 == 0 else lang), None if k % 10 == 9 else f"h{k % 3}.{'x' if k % 2 else 'y'}.{lang if k % 4 else 'org'}"))
    rows.append(("mae hynny wrth", "cy", None))
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(3)
    got = {r.id: r for r in o2.language_id(df, "doc_id", "text", declared="lang", host="source").collect()}
    for k, (lang, prob) in enumerate(brute(rows)):
        assert got[k].lang == lang and abs(got[k].prob - prob) < 1e-6, (k, rows[k], got[k], lang, prob)


def test_rare_languages_have_a_model(spark):
    """Four documents of a language among thousands have a model of their own; languages of fewer than LEAST are OTHER, not one of the large ones."""
    rows = [(k, make("en de fr".split()[k % 3], 30, k), "en de fr".split()[k % 3]) for k in range(3000)]
    rare = {"fi": "tämä talo seisoo yksin järven rannalla kun kesä saapuu metsään hiljaa", "eu": "eta ezin baina honek zuen dugu bertan gizonak etxera", "cy": "mae hynny wrth gyfer llywodraeth ysgol ddweud rhywbeth"}
    rows += [(4000 + k, " ".join([rare["fi"]] * (3 + k)), "fi") for k in range(4)]
    rows += [(5000 + k, " ".join([rare[x]] * 5), x) for k, x in enumerate(("eu", "cy"))]
    rows += [(5100, " ".join([rare["eu"]] * 5), None), (5200, make("en", 40, 9), "eu"), (5300, rare["fi"], None), (5400, "sana " * 200_000, "fi")]
    got = {r.id: r for r in o2.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", declared="lang").collect()}
    assert all(got[k].lang == "en de fr".split()[k % 3] and got[k].kept for k in range(3000))
    assert all(got[k].lang == got[k].text_lang == "fi" and got[k].kept for k in (4000, 4001, 4002, 4003, 5300))
    assert all(got[k].lang == got[k].text_lang == o2.OTHER and got[k].kept for k in (5000, 5001, 5100))
    assert got[5200].lang == "en" and got[5200].declared == "eu" and not got[5200].kept


def test_clashing_names(spark):
    rows = [(k, make("en", 30, k), "en", "s", 1, "x", 0.5, True) for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id int, declared string, prob double, kept boolean")
    got = o2.keep_identified(df)
    assert got.columns == df.columns and got.count() == 9
