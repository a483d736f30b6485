import random
import zlib
from collections import Counter

import numpy as np

from tickerloom.llm import language_id, pseudo_likelihood, sampling, toxicity

SYLLABLES = {"en": ["the", "ing", "er", "and", "tion"], "de": ["der", "sch", "ung", "ein", "ü"], "fr": ["le", "eau", "oi", "é", "que"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_of_held_out_documents(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(5, 60)), lang) for i in range(400)]
    odd = [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "", None), (None, "the ing", None), (1003, "the ing " * 30_000, "de")]
    docs = spark.createDataFrame([(*r, 1) for r in rows + odd], "doc_id long, text string, lang string, score int")
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows) + len(odd)
    true = {i: lang for i, _, lang in rows}
    held = [r for r in got if r.doc_id in true and r.held_out]
    assert held and np.mean([r.lang_pred == true[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002, None, 1003)] == ["und", "und", "und", "en", "en"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert language_id.identify(docs.limit(0)).count() == 0


def test_languages_with_long_texts_only_are_learnt(spark):
    rng = random.Random(5)
    rows = [(i, text(rng, "de", 20), "de") for i in range(40)]
    rows += [(100 + i, (text(rng, "fr", 300) + " ") * 40, "fr") for i in range(40)]
    assert min(len(t) for i, t, _ in rows if i >= 100) > language_id.LONGEST
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for some in (rows, rows[40:]):
        ids = {i for i, *_ in some}
        got = language_id.identify(docs.where(docs.doc_id.isin(*ids))).collect()
        assert {(r.lang_pred, r.doc_id >= 100) for r in got} == {(lang, i >= 100) for i, _, lang in some}


def test_letters_of_every_plane():
    for letter in ("a", "\u00e9", "\U00020000", "\U00032010"):
        assert len(language_id.grams_of(letter))
    assert not len(language_id.grams_of("12 \U000E0041 \U000F0000"))


def test_sample_takes_short_texts_first_and_some_of_every_label(spark):
    rows = [("a", "x" * n) for n in (3, 5, 9, 12, 20)] * 2 + [("b", "y" * 400), ("b", "y" * 500), ("c", None), (None, "z")]
    docs = spark.createDataFrame(rows, "k string, text string")
    taken = lambda most, room: sorted(
        (r.k, len(r.text)) for r in sampling.sample_per_label(docs, "k", most, 10, room).collect()
    )
    assert taken(3, 1000) == [("a", 3), ("a", 5), ("a", 9), ("b", 400), ("b", 500)]
    assert taken(9, 35) == [("a", 3), ("a", 5), ("a", 9), ("a", 12), ("b", 400)]


def test_temperature_lowers_the_log_loss():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 500)
    logits = 8 * (np.eye(3)[labels] + rng.normal(0, 1.0, (500, 3)))
    t = language_id.fit_temperature(logits, labels)
    loss = lambda t: float(np.mean([-np.log(language_id.softmax(x / t)[y]) for x, y in zip(logits, labels, strict=True)]))
    assert t > 1.5 and loss(t) < loss(1.0) and loss(t) <= min(loss(t * 0.9), loss(t * 1.1))


def toxic_rows(rng, n):
    abuse = ["idiot", "scum", "zorkab", "zorked", "zorkish", "zorkum"]
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        words = text(rng, "en", rng.randint(8, 60)).split()
        if bad:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(abuse))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_of_held_out_documents(spark):
    rows, labels = toxic_rows(random.Random(2), 900)
    odd = [(5000, None), (5001, ""), (None, "scum idiot"), (5002, "ing and " * 30_000 + "scum zorkab idiot"), (5002, "ing and")]
    docs = spark.createDataFrame([(i, t, 3, "x") for i, t in rows + odd], "doc_id long, text string, toxic int, score string")
    marks = spark.createDataFrame([*labels, (5000, 1), (None, 1), (5003, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == len(rows) + len(odd)
    true = dict(labels)
    held = [r for r in got if r.doc_id in true and r.held_out]
    assert sum(r.predicted == true[r.doc_id] for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert {(r.doc_id, r.predicted) for r in got if r.doc_id not in true} == {(5000, 0), (5001, 0), (None, 1), (5002, 1), (5002, 0)}
    stay = toxicity.without_toxic(docs, marks)
    assert stay.columns == docs.columns
    clean = {r.doc_id for r in stay.collect()}
    assert sum((i in clean) != (not y) for i, y in labels) <= 0.02 * len(labels)


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.toxicity(docs, none).collect()] == [0, 0]
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def test_label_model_finds_accurate_voters_and_tied_ones():
    rng = np.random.default_rng(1)
    y = rng.random(3000) < 0.3
    good = [(y & (rng.random(3000) < 0.6)) | (rng.random(3000) < 0.01) for _ in range(3)]
    noise = rng.random(3000) < 0.3
    silent = ~np.any(good, axis=0)
    v = np.column_stack([*good, good[0], noise, silent]).astype(float)
    model = toxicity.fit_label_model(v, 4, 0.3)
    gain = np.log(model.fires[1] / model.fires[0])
    assert min(gain[:4]) > 1.5 > abs(gain[4]) * 5
    assert max(model.share[0], model.share[3]) < 0.7 < model.share[1]
    assert np.mean((model.posterior(v) > 0.5) == y) > 0.9


def test_gradient_of_the_window_network():
    rng = np.random.default_rng(0)
    net = pseudo_likelihood.Network.start(20)
    context = rng.integers(0, 20, (50, 2 * pseudo_likelihood.WINDOW))
    label = rng.integers(0, pseudo_likelihood.CLASSES, 50)
    loss = lambda: -float(net.log_class(context, label).sum())
    squares = [np.full(p.shape, 1e-4, np.float32) for p in net.parts()]
    first = loss()
    for _ in range(60):
        pseudo_likelihood.train_pass(net, squares, context, label, 0.05)
    assert loss() < 0.5 * first


def test_large_logits_of_the_window_network_stay_finite():
    net = pseudo_likelihood.Network.start(20)
    context, label = np.arange(40).reshape(10, 4) % 20, np.arange(10)
    for scale in (1.0, 1e4):
        net.w2 = (net.w2 / np.abs(net.w2).max() * scale).astype(np.float32)
        x, h, z = net.forward(context)
        assert (np.abs(z).max() <= pseudo_likelihood.LOGITS) if scale == 1.0 else (z.max() == 0.0)
        exact = h.astype(float) @ net.w2
        top = exact.max(axis=1)
        want = exact[label, label] - top - np.log(np.exp(exact - top[:, None]).sum(axis=1))
        got = net.log_class(context, label)
        possible = want > -80  # less is the logarithm of a vanished chance
        assert np.isfinite(got).all() and np.allclose(got[possible], want[possible], rtol=1e-3, atol=0.05)
        squares = [np.full(p.shape, 1e-4, np.float32) for p in net.parts()]
        pseudo_likelihood.train_pass(net, squares, context, label, 0.05)
        assert all(np.isfinite(p).all() for p in net.parts())


def test_pseudo_likelihood_prefers_the_order_it_has_seen(spark):
    rng = random.Random(3)
    chain = {"a": "b", "b": "c", "c": "d", "d": "e", "e": "a"}

    def walk(n):
        out = [rng.choice("abcde")]
        while len(out) < n:
            out.append(chain[out[-1]] if rng.random() < 0.95 else rng.choice("abcde"))
        return out

    rows = [(i, " ".join(walk(200))) for i in range(300)]
    shuffled = walk(400)
    plain = " ".join(shuffled)
    rng.shuffle(shuffled)
    odd = [(1000, plain), (1001, " ".join(shuffled)), (1002, None), (1003, " \n"), (None, "a b c"), (None, "a b c")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows + odd], "doc_id long, text string, n_tokens int").repartition(4)
    got = pseudo_likelihood.masked_pseudo_likelihood(docs).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1000].mean_log_likelihood > by_id[1001].mean_log_likelihood + 0.2
    assert (by_id[1002].n_tokens, by_id[1002].log_likelihood, by_id[1002].mean_log_likelihood) == (0, 0.0, None)
    assert by_id[1003].n_tokens == 0
    twice = [r.log_likelihood for r in got if r.doc_id is None]
    assert twice[0] == twice[1]
    assert abs(by_id[1000].log_likelihood - by_id[1000].n_tokens * by_id[1000].mean_log_likelihood) < 1e-6
    assert pseudo_likelihood.masked_pseudo_likelihood(docs.limit(0)).count() == 0


def test_every_word_has_its_own_chance_and_frequent_words_their_own_entry(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcde") for _ in range(40))) for i in range(100)]
    rows += [(100 + i, "a b koring d e") for i in range(4)] + [(200, "a b boring d e"), (201, "a b xoring d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    by_id = {r.doc_id: r.log_likelihood for r in pseudo_likelihood.masked_pseudo_likelihood(docs, vocabulary=2).collect()}
    assert abs(by_id[100] - by_id[200] - np.log(4)) < 1e-4 and abs(by_id[200] - by_id[201]) < 1e-4
    counts = pseudo_likelihood.word_counts(docs)
    lexicon = pseudo_likelihood.build_lexicon(counts, 2)
    assert list("abcde") == sorted(lexicon.number)  # more than the 2 asked for: all that are frequent
    chance = np.zeros(pseudo_likelihood.CLASSES)
    for word, n in counts.collect():
        entry = lexicon.reader()[word]
        chance[lexicon.classes[entry]] += np.exp(lexicon.own[entry]) * (1 if word in lexicon.number else n)
    assert np.allclose(chance[chance > 0], 1.0)


def test_every_token_of_short_texts_is_a_training_target(spark):
    rows = [(i, "up down" if i % 2 else "left") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = pseudo_likelihood.word_counts(docs)
    lexicon = pseudo_likelihood.build_lexicon(counts)
    texts = pseudo_likelihood.encoded(docs, lexicon)
    start, net = pseudo_likelihood.Network.start(lexicon.edge + 1), pseudo_likelihood.train(texts, lexicon)
    edge, up, down = lexicon.edge, lexicon.number["up"], lexicon.number["down"]
    context = np.array([[edge, edge, down, edge], [edge, up, edge, edge], [edge, edge, edge, edge]])
    label = lexicon.classes[[up, down, lexicon.number["left"]]]
    assert all(net.log_class(context, label) > start.log_class(context, label) + 0.1)


def test_toxicity_learns_from_long_texts_only(spark):
    rows, labels = toxic_rows(random.Random(6), 240)
    plain = text(random.Random(7), "en", 400)
    long = [(i, f"{t} " + (plain + " ") * 40) for i, t in rows]
    assert min(len(t) for _, t in long) > toxicity.LONGEST
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(spark.createDataFrame(long, "doc_id long, text string"), marks).collect()
    true = dict(labels)
    assert sum(r.predicted == true[r.doc_id] for r in got if r.held_out) >= 0.95 * sum(r.held_out for r in got)


def test_tokens_are_those_of_the_pattern():
    find = pseudo_likelihood.TOKEN.findall
    texts = ["", " ", "a,b  c_d.\x1ce\u3000f", "ΑΣ. ΑΣ İI \u0301x ²½ 中文。", "\x00\x7f\ud800-€🙂🙂", "".join(map(chr, range(0x300)))]
    texts += [" a".join(map(chr, range(k, k + 16))) for k in range(0, 0x110000, 16)]
    for text in texts:
        assert pseudo_likelihood.tokens(text) == find(text.lower())


def test_words_of_a_batch_are_split_without_a_list_of_strings():
    texts = ["", " ", "a,b  c_d.\x1ce\u3000f\x85g\xa0h", "\x1d", "\n x\r\ny\x0b.\x0c", "".join(map(chr, range(0x300)))]
    words, sizes = pseudo_likelihood.words_of(texts)
    want = [pseudo_likelihood.TOKEN.findall(t.lower()) for t in texts]
    assert words.to_pylist() == [w for found in want for w in found] and sizes.tolist() == [len(found) for found in want]
    assert len(pseudo_likelihood.words_of([])[0]) == 0


def test_entries_and_rare_words_of_a_batch(spark):
    texts = ["the cat, the DOG", "", "   ", "dog dog the. zebra dog", "the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = pseudo_likelihood.word_counts(docs)
    found = {t: pseudo_likelihood.TOKEN.findall(t.lower()) for t in texts}
    assert {r.word: r.n for r in counts.collect()} == Counter(w for words in found.values() for w in words)
    lexicon = pseudo_likelihood.build_lexicon(counts, 2)
    read = lexicon.reader()
    for r in pseudo_likelihood.encoded(docs, lexicon).collect():
        words = found[texts[r.doc_id]]
        assert np.frombuffer(r.entries, np.int32).tolist() == [read[w] for w in words]
        assert dict(zip(r.rare, r.times, strict=True)) == Counter(w for w in words if w not in lexicon.number)
