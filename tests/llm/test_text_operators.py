import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

from spanloom.llm import chat, decontaminate, licenses, mixing, toxicity, url_rules

DOCS = "doc_id long, text string"


def test_toxicity_learns_from_rows_that_are_not_held_out(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    docs, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        body = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if toxic:
            body.insert(rng.randrange(len(body)), rng.choice(["vileness", "vileword", "viles"]))
        docs.append((i, " ".join(body), 0.5))
        labels.append((i, 1, int(toxic)))
    docs += [(1000, None, 0.1), (1001, "", 0.1), (None, "viles", 0.1), (1002, "viles " * 20000, 0.1), (3, docs[3][1], 0.1)]
    labels += [(0, 1, 1), (9999, 0, 1), (1, None, None), (None, 0, 1)]
    got = toxicity.toxicity(spark.createDataFrame(docs, DOCS + ", score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert len(held) > 100 and sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.97
    none = toxicity.toxicity(spark.createDataFrame(docs[:5], DOCS + ", score double"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert all(r.predicted == 0 for r in none.collect())


def test_toxicity_model_is_the_same_for_any_order_of_rows(spark):
    rng = random.Random(2)
    rows = [(" ".join(rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(20)), rng.randrange(2)) for _ in range(300)]
    rows += rows[:5]
    models = [toxicity.train(spark.createDataFrame(given, "text string, toxic int").repartition(n), l1=0.1) for given, n in ((rows, 3), (rows[::-1], 5))]
    assert len(models[0][0]) > 50 and models[0][2] == models[1][2]
    assert all((a == b).all() for a, b in zip(models[0][:2], models[1][:2], strict=True))


def test_mix_meets_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, "a " * rng.randint(0, 40), s) for i, s in enumerate(["b"] * 30 + ["a"] * 400 + [None] * 50 + ["z"] * 3)]
    rows += [(7, rows[7][1], "b"), (None, "a b c", "b"), (900, None, "b"), (901, "", "empty")]
    df = spark.createDataFrame(rows, DOCS + ", source string").selectExpr("*", "1 as size", "'x' as target")
    first = mixing.mix_sources(df, None).collect()
    again = mixing.mix_sources(df.repartition(5), None).collect()
    order = lambda rows: sorted(map(str, rows))
    assert len(first) == len(rows) and order(first) == order(again)
    by_source = {}
    for r in mixing.mix_sources(df, None, keep=("source",)).collect():
        assert 0 <= r.taken <= 3 * r["size"]
        s = by_source.setdefault(r.source, [0, r.source_size, r.target])
        s[0] += r.taken
    assert all(abs(taken - target) <= 1 for taken, _, target in by_source.values())
    assert abs(sum(t for _, _, t in by_source.values()) - sum(n for _, n, _ in by_source.values())) < 1e-6
    assert all(t <= 3 * n for _, n, t in by_source.values())
    assert mixing.mix_sources(df.limit(0), None).count() == 0


def test_chats_survive_hostile_texts(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\", "<", "<<|", "", None, "line\n\nline", "<\\\\|x", "a" * 50_000, "\ue000"]
    rows = [(k, t, role, text) for k, text in enumerate(texts) for t, role in ((1, "user"), (2, "assistant"), (3, "assistant"))]
    rows += [(77, 1, "we\nird<|", "x"), (77, None, None, "y"), (77, 1, "we\nird<|", "x")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as n_turns")).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for k, text in enumerate(texts):
        text = text or ""
        assert (got[k].n_turns, got[k].loss_chars, got[k].loss_sha256) == (3, 2 * len(text), sha(text * 2))
        assert got[k].turns_sha256 == sha("".join(f"{r}\n{text}\n" for r in ("user", "assistant", "assistant")))
        assert not got[k].rewrites and got[k].formatted_chars == len(got[k].formatted)
    assert got[77].turns_sha256 == sha("null\ny\n" + "we\nird<|\nx\n" * 2)


def test_templates_that_rewrite_history_are_flagged():
    turns = [("user", "a"), ("assistant", "b")]
    assert chat.spans(turns, lambda t: f"{len(t)}:" + chat.chatml(t))[1] is None
    assert chat.spans(turns, chat.chatml)[1] is not None


def test_reparameterised_questions_are_found(spark):
    question = "A train leaves {a} at {x} and runs {y} km to {b} while carrying {z} passengers so how long does the trip back to {a} take at night?"
    fill = lambda **v: question.format(**v)
    items = [(1, fill(a="Berlin", b="Hamburg", x="8:15", y="75", z="42")), (2, "to be or not"), (3, None), (4, "")]
    docs = [
        (1, "Some words first. " + fill(a="Berlin", b="Hamburg", x="8:15", y="75", z="42") + " And after."),
        (2, fill(a="Paris Nord", b="Lille", x="9:30", y="120", z="1,300")),
        (3, "A train leaves Rome at 9:30 and runs 120 km to Pisa while carrying 300 passengers so how long does the trip back to Turin take at night?"),
        (4, "Nothing of the kind is said here, and nobody will find it in this text of ours."),
        (5, None), (6, ""), (1, "Some words first. " + fill(a="Berlin", b="Hamburg", x="8:15", y="75", z="42") + " And after."),
    ]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "0L as item_id", "'k' as kind")
    got = decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as length"))
    found = {(r.doc_id, r.item_id): (r.kind, r.coverage) for r in got.collect()}
    assert found[1, 1] == ("exact", 1.0) and found[2, 1] == ("reparameterised", 1.0)
    assert (3, 1) not in found or found[3, 1][1] < 1.0
    assert not {d for d, _ in found} & {4, 5, 6}
    assert decontaminate.contaminated(df.limit(0), got.select("item_id").withColumn("text", got.item_id.cast("string"))).count() == 0


def test_short_quoted_and_partly_copied_items_are_found(spark):
    long = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(600)]
    items = [(1, "Who wrote Hamlet?"), (2, "12 + 7 * 3 = ?"), (3, "What is the capital of France and why?"), (4, " ".join(long)), (5, "Zürich?")]
    docs = [
        (1, "He asked her WHO WROTE HAMLET and went."), (2, "So 12 + 7 * 3 = 33."), (3, "Question: What is the capital of France and why? Answer."), (4, "Question: What is the capital of Spain and why? Answer."),
        (5, "before it " + " ".join(long[200:300]) + " after it"), (6, "Who wrote, asked Hamlet. 12 and 7 and 3. What is the capital?"), (7, "ten words of it " + " ".join(long[200:210])), (8, "in ZÜRICH"),
    ]
    got = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.kind for r in got} == {(1, 1): "exact", (2, 2): "exact", (3, 3): "exact", (4, 3): "reparameterised", (5, 4): "exact", (8, 5): "exact"}
    assert len(got) == 6


def test_url_rules(spark):
    urls = ["http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x", "http://example.org/en/2", "http://x.com/fr/a#b", "http://com/de/", "http://notexample.org/es/", "http://a.org", "no url", None, "", "http://", "x://h.net/fr/", "http://org/" + "a/" * 3000]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string").selectExpr("*", "'h' as host", "1 as rule")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.url_verdicts(df, url_rules.default_rules(spark)).collect()}
    want = [("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block"), ("org/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("org/", "allow")]
    assert got == dict(enumerate(want))
    assert all(r.verdict == "allow" for r in url_rules.url_verdicts(df, url_rules.default_rules(spark).limit(0)).collect())


def test_license_notices(spark):
    plain = [(i, f"word{i} other words here and there\nsecond line of the text {i}") for i in range(40)]
    wrapped = "# Permission is hereby granted, free of charge, to any person obtaining a copy\n#  of this software and associated documentation files (the Software), to deal\n# in the Software without restriction."
    docs = [
        *plain, (100, "intro\nReleased under the MIT License."), (101, "Licensed under CC BY-NC 4.0. and more text follows"), (102, "x\n\nThis work is licensed under the GNU General Public License, version 3."),
        (103, "Licensed under the Meadow Software License 5."), (104, None), (105, ""), (100, "intro\nReleased under the MIT License."), (106, f"code\n\n{wrapped}\n\nmore"), (107, "Licensed under the GNU General Public License, version 4."),
        (108, "This work is licensed under the GNU Lesser General Public License, version 3."), (109, "Licensed under CC BY-ND 4.0."), (110, "Released under the MIT License. Licensed under CC BY 4.0."), (111, "plain words " * 30_000 + "\nReleased under the MIT License.\n" + "plain words " * 30_000),
    ]
    got = licenses.license_scan(spark.createDataFrame(docs, DOCS).selectExpr("*", "'f' as family", "1 as line")).collect()
    found = {(r.doc_id, r.paragraph, r.line, r.family): r.confirmed for r in got}
    sure = {(100, 0, 1, "MIT"), (101, 0, 0, "CC-BY-NC-4.0"), (102, 1, 2, "GPL-3.0"), (106, 1, 2, "MIT"), (108, 0, 0, "LGPL-3.0"), (109, 0, 0, "CC-BY-ND-4.0"), (110, 0, 0, "MIT"), (110, 0, 0, "CC-BY-4.0"), (111, 0, 1, "MIT")}
    assert found == dict.fromkeys(sure, True) | {(103, 0, 0, "unknown"): False, (107, 0, 0, "unknown"): False}
    assert len(got) == 12
    row = next(r for r in got if r.doc_id == 102)
    assert docs[42][1].encode()[row.start : row.end].decode() == "This work is licensed under the GNU General Public License, version 3."
    row = next(r for r in got if r.doc_id == 106)
    assert docs[47][1][row.start : row.end] == wrapped + "\n"
    assert licenses.license_scan(spark.createDataFrame([], DOCS)).count() == 0


# notices in other words, none of whose templates is there by seven tenths: what the classifier takes them for
HELD_OUT = {
    "Permission to deal in the software without restriction is granted, free of charge, to whoever obtains a copy, provided that this permission notice is kept.": True,
    "You may redistribute and modify this program under the GNU General Public License as published by the Free Software Foundation.": True,
    "Redistributions in binary form must reproduce the copyright notice; the software is provided by the copyright holders as it is.": True,
    "The committee met on the second day of the month and talked about the bridge.": False,
    "Use of the kitchen is free for all members of the club in the evening.": False,
    "This is the only version of the story that was told without any restriction.": False,
}


def test_the_classifier_decides(spark, monkeypatch):
    """Held-out wordings are notices by the classifier alone, and without its say templates find nothing."""
    rows = [(i, t) for i, t in enumerate(HELD_OUT)] + [(90, "Released under the MIT License."), (91, "plain"), *((100 + i, f"ordinary line number {i} of the text that was written in the year {i}") for i in range(60))]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert set(got) == {i for i, yes in enumerate(HELD_OUT.values()) if yes} | {90}
    assert all(got[i].similarity < 0.7 and not got[i].confirmed and got[i].probability >= 0.5 for i in got if i != 90) and got[90].confirmed
    model = licenses.Model([t for _, t in rows[-60:]])
    own = licenses._grams(licenses._words("Released under the MIT License."))
    assert [x[0] for x in model.families(own, own, 0.5, 0.7, 0.05)] == ["MIT"]
    monkeypatch.setattr(model, "prior", np.where(np.array(model.classes) == "none", 1000.0, 0.0))
    assert model.families(own, own, 0.5, 0.7, 0.05) == []
    monkeypatch.setattr(model, "prior", np.where(np.array(model.classes) == "GPL-3.0", 1000.0, 0.0))
    assert [x[::3] for x in model.families(own, own, 0.5, 0.7, 0.05)] == [("unknown", False)]


def test_license_notices_of_the_test_table(spark):
    """Against a plain search for the notices, on all documents of sf0.01."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    flat = lambda t: " " + " ".join(re.findall("[a-z0-9]+", (t or "").lower())) + " "
    texts = {r.doc_id: flat(r.text) for r in docs.collect()}
    want = {(i, f) for i, t in texts.items() for f, notices in licenses.TEMPLATES.items() for n in notices if flat(n) in t}
    got = {(r.doc_id, r.family) for r in licenses.license_scan(docs).collect()}
    assert got == want and len(want) > 30


def reference_features(text):
    """The documented features, as strings."""
    words = re.findall(rb"[0-9A-Za-z'\x80-\xff]+", (text or "").encode().lower())
    out = {("w", w) for w in words} | {("2", *p) for p in zip(words, words[1:])} | {("skip", *p) for p in zip(words, words[2:])}
    return out | {("stem", k, w[:k]) for w in words for k in (4, 5, 6) if len(w) > k}


def reference_model(rows, alpha=2.0, beta=1.0, l1=5.0, epochs=8, least=3):
    """FTRL-proximal over dictionaries; rows (text, label) in the order of training."""
    sets = [reference_features(t) for t, _ in rows]
    count = Counter(f for s in sets for f in s)
    sets = [{f for f in s if count[f] >= least} for s in sets]
    z, n, bz, bn = Counter(), Counter(), 0.0, 0.0
    weight = lambda f: 0.0 if abs(z[f]) <= l1 else (math.copysign(l1, z[f]) - z[f]) / ((beta + math.sqrt(n[f])) / alpha)
    shuffle = np.random.default_rng(7)
    for _ in range(epochs):
        for d in shuffle.permutation(len(rows)):
            w = {f: weight(f) for f in sets[d]}
            bias = -bz / ((beta + math.sqrt(bn)) / alpha)
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()) + bias)))) - rows[d][1]
            for f in sets[d]:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w[f]
                n[f] += g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / alpha * bias
            bn += g * g
    # the bias of a round is that before its last update, as in training
    return {f: weight(f) for f in z if weight(f)}, bias


def test_toxicity_against_a_plain_model(spark):
    rng = random.Random(8)
    words = [f"wörd{k}" for k in range(40)]
    rows = []
    for i in range(260):
        body = [rng.choice(words) for _ in range(rng.randint(3, 25))]
        if i % 3 == 0:
            body.insert(rng.randrange(len(body)), rng.choice(["vileness", "Vileword's"]))
        rows.append((i, " ".join(body) + "."))
    rows += [(500, None), (501, ""), (502, "vileness " * 5000)]
    labels = {i: int(i % 3 == 0) for i in range(260)}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    use = sorted(((t, labels[i]) for i, t in rows if i in labels and not held(i)), key=lambda r: (np.uint64(xxhash.xxh64_intdigest(r[0].encode(), 42)).view(np.int64), r[1], r[0]))
    weights, bias = reference_model(use)
    assert len(weights) > 5
    got = toxicity.toxicity(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, t) for i, t in labels.items()], "doc_id long, toxic int"))
    for r in got.collect():
        total = bias + sum(weights.get(f, 0.0) for f in reference_features(dict(rows)[r.doc_id]))
        assert abs(r.score - 1 / (1 + math.exp(-max(-35, min(35, total))))) < 1e-6 and r.held_out == held(r.doc_id)


def test_toxicity_undoes_the_shares_of_its_sample(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice("abcdefghij") * 3 for _ in range(20)) + (" vileness" if i % 10 == 0 else "")) for i in range(800)]
    docs += docs[:10]  # an id counts once
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(800)], "doc_id long, toxic int")
    sample, shift = toxicity.training_sample(spark.createDataFrame(docs, DOCS), labels, 1000, 60, 10_000)
    shares = {r.toxic: r.n for r in sample.groupBy("toxic").count().withColumnRenamed("count", "n").collect()}
    usable = [sum(1 for i in range(800) if (i % 10 == 0) == k and zlib.crc32(str(i).encode()) % 4 != 2) for k in (False, True)]
    assert shares == {0: 60, 1: usable[1]} and abs(shift - math.log(60 / usable[0])) < 1e-9
    assert toxicity.toxicity(spark.createDataFrame([], DOCS), labels).count() == 0


def folded_words(text):
    """Case-folded words as the verbatim windows see them."""
    lower = (text or "").encode().lower().decode()
    return re.findall(r"[0-9a-z'\x80-\U0010ffff]+", re.sub("[À-ÖØ-Þ]", lambda m: m[0].lower(), lower))


def test_verbatim_items_against_brute_force(spark):
    rng = random.Random(10)
    vocabulary = ["al", "Be", "cé", "DÜ", "éo", "fi", "gu", "12", "7", "ho's"]
    say = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "."]) for _ in range(n))
    items = [(k, say(rng.choice([1, 3, 7, 8, 9, 20, 60]))) for k in range(30)] + [(99, None), (98, "?!")]
    docs = []
    for d in range(60):
        text = say(rng.randint(0, 30))
        for _ in range(rng.randint(0, 2)):
            item = rng.choice(items)[1] or ""
            parts = item.split()
            a = rng.randint(0, max(0, len(parts) - 8))
            text += " " + " ".join(parts[a : a + rng.randint(6, 60)]).upper() + " " + say(3)
        docs.append((d, text))
    docs += [(70, None), (71, ""), (72, say(20_000))]
    want = set()
    for i, item in items:
        words = folded_words(item)
        size = min(8, len(words))
        pos = [tuple(words[k : k + size]) for k in range(len(words) - size + 1)] if words else []
        for d, text in docs:
            own = folded_words(text)
            seen = {}
            for k in range(len(own) - size + 1 if size else 0):
                seen.setdefault(tuple(own[k : k + size]), []).append(k)
            match = [k for k, w in enumerate(pos) if w in seen]
            runs = any(all(a + j in seen.get(pos[p + j], ()) for j in range(13)) for p in range(len(pos) - 12) for a in seen.get(pos[p], ()))
            if pos and (len(match) / len(pos) >= 0.3 or runs):
                want.add((d, i))
    got = decontaminate.contaminated(spark.createDataFrame(docs, DOCS).selectExpr("*", "'x' as rid", "0 as hash"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert want <= {(r.doc_id, r.item_id) for r in got} and len(want) > 30


def test_numbering_templates_get_right_masks():
    numbered = lambda turns: "".join(f"[{k}] {r}: {chat.escape(t)}\n" for k, (r, t) in enumerate(turns, 1))
    turns = [(("user", "assistant")[k % 2], f"answer {k}") for k in range(30)]
    rendered, found = chat.spans(turns, numbered)
    assert [rendered[a:b] for a, b in chat.loss_spans(rendered, turns, found, numbered)] == [t for r, t in turns if r == "assistant"]
    by_text = lambda turns: "".join(f"{len(t)} {r}: {t}\n" for r, t in turns)
    rendered, found = chat.spans(turns, by_text)
    assert chat.loss_spans(rendered, turns, found, by_text) is None


def test_empty_tables(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.url_verdicts(pages, url_rules.default_rules(spark)).count() == 0
    assert decontaminate.contaminated(spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_null_ids_of_items_and_documents_are_ids(spark):
    text = "the quick brown fox jumps over the lazy dog near the old river bank today"
    docs = spark.createDataFrame([(None, f"before {text} after", 5), (2, f"{text} and more", 5), (3, "nothing of the kind", 5), (4, None, 5)], "doc_id long, text string, n_windows int")
    items = spark.createDataFrame([(None, text, 1), (7, text, 1), (None, None, 1), (8, "", 1)], "item_id long, text string, pos int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(d, i) for d in (None, 2) for i in (None, 7)}
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0 and decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_very_long_urls_and_empty_pages(spark):
    deep = "https://" + "a." * 2000 + "example.org/es/" + "x/" * 50_000
    pages = spark.createDataFrame([(1, deep, "v"), (1, deep, "v"), (2, "https://" + "h" * 100_000, "v")], "page_id long, url string, verdict string")
    got = sorted((r.page_id, r.rule or "", r.verdict) for r in url_rules.url_verdicts(pages, url_rules.default_rules(spark)).collect())
    assert got == [(1, "example.org/es/", "block")] * 2 + [(2, "", "allow")]
    assert url_rules.url_verdicts(pages.limit(0), url_rules.default_rules(spark)).count() == 0
