from tablewright.llm import language_id


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert len(found) == docs.count() and len(held) > 100
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_backs_off_for_unseen_words(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("the thing there thanks", "en"), ("der die schule schon schatz", "de")] * 20)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    found, score = model.predict(["schumm", "thunk", "", "123 !", "zz", "Schule THE der"])
    assert found[:4] == ["de", "en", "und", "und"] and score[2] == score[3] == 0
    assert found[5] == "de" and 0.5 < score[5] <= 1


def test_word_scores_by_hand(spark):
    import math

    rows = [(1, "aa ab", "x"), (2, "aa bb", "y")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    _, score = model.predict(["ab"])
    x, y = math.log(1.5 / (2 + 0.5 * 3)), math.log(0.5 / (2 + 0.5 * 3))  # two kinds of words in each language
    assert abs(score[0] - 1 / (1 + math.exp(y - x))) < 1e-9
    # "abb" is unseen: of its two-letter grams "ab" and "bb" both are known, longer ones are not
    gram = {"x": {"aa": 1, "ab": 1}, "y": {"aa": 1, "bb": 1}}
    logs = {k: sum(math.log((g.get(w, 0) + 0.5) / (2 + 0.5 * 3)) for w in ("ab", "bb")) / 2 for k, g in gram.items()}
    found, score = model.predict(["abb"])
    assert found == ["x"] and abs(score[0] - 1 / (1 + math.exp(logs["y"] - logs["x"]))) < 1e-9


def test_odd_rows(spark, odd_docs):
    model = language_id.fit_on_documents(odd_docs)
    found = language_id.identify(odd_docs, model)
    assert set(found.columns) == set(odd_docs.columns)
    rows = found.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    empty = language_id.fit_on_documents(odd_docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(odd_docs, empty).collect()} == {"und"}
    assert language_id.identify(odd_docs.limit(0), model).count() == 0


def by_hand(labelled, texts, entries):
    """The same rules in plain Python, one text at a time: (language, score)."""
    import math
    from collections import Counter

    import numpy as np

    def words(text):
        return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()

    def grams(word, n):
        return [word[i : i + n] for i in range(len(word) - n + 1)] if n else [word]

    def place(gram):  # equally frequent entries go by their hash
        codes = np.array([ord(c) for c in gram], np.uint32)
        return int(language_id.span_hashes(codes, np.array([0]), np.array([len(gram)])).view(np.int64)[0])

    rows = [(t, x) for i, t, x in labelled if i is not None and t is not None and x is not None]
    counts = {}
    for text, lang in rows:
        for word in words(text):
            for n in range(6):
                counts.setdefault((n, lang), Counter()).update(grams(word, n))
    langs = sorted({x for n, x in counts})
    kept = {n: {g for x in langs for g in sorted(counts.get((n, x), {}), key=lambda g: (-counts[n, x][g], place(g)))[:entries]} for n in range(6)}
    kinds = {n: max((len(counts.get((n, x), {})) for x in langs), default=0) for n in range(6)}
    sizes = {(n, x): sum(counts.get((n, x), {}).values()) for n in range(6) for x in langs}

    def log(n, x, g):
        return math.log((counts.get((n, x), {}).get(g, 0) + 0.5) / (sizes[n, x] + 0.5 * (kinds[n] + 1)))

    found = []
    for text in texts:
        own = words(text)
        if not own or not langs:
            found.append(("und", 0.0))
            continue
        total = {x: math.log((sizes[0, x] + 1) / (sum(sizes[0, y] for y in langs) + len(langs))) for x in langs}
        for word in own:
            for n in (0, 5, 4, 3, 2, 1):
                known = [g for g in grams(word, n) if g in kept[n]]
                if known:
                    for x in langs:
                        total[x] += sum(log(n, x, g) for g in known) / len(known)
                    break
        top = max(total.values())
        found.append((next(x for x in langs if total[x] == top), 1 / sum(math.exp(v - top) for v in total.values())))
    return found


def test_whole_documents_against_plain_python(spark, documents, odd_docs):
    """Every whole text, with a model that keeps all entries and one that keeps few; repeated rows and ties included."""
    few = spark.createDataFrame(
        [(1, "aa bb", "x"), (1, "aa bb", "x"), (2, "bb aa", "y"), (2, "bb aa", "y"), (3, "cc", "z")], "doc_id long, text string, lang string"
    )  # x and y tie everywhere
    for docs, entries in ((few, 1), (few, 100), (odd_docs, 3), (documents, 40), (documents, 50_000)):
        rows = docs.select("doc_id", "text", "lang").collect()
        model = language_id.fit(docs, entries=entries)
        texts = [r.text or "" for r in rows] + ["aa", "bb aa", "zz", "ab"]
        langs, scores = model.predict(texts)
        want = by_hand(rows, texts, entries)
        for lang, score, (told, sure) in zip(langs, scores, want, strict=True):
            assert abs(score - sure) < 1e-6 and (lang == told or abs(sure - 0.5) < 1e-6)


def test_a_small_language_keeps_its_words_beside_a_large_one(spark):
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + j)}q" for j in range(26)), "big") for i in range(260)]
    rows += [(1000, "mira sol vena", "tiny")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), entries=30)
    assert len(model.keys[0]) == 33
    assert model.predict(["mira vena sol"])[0] == ["tiny"]
