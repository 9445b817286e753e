from pyspark.sql import functions as F

from corvine.llm import langid as L

TEXTS = {
    "en": "The order queue rebuilds every missing edge before the cache is filled. Nobody should change this setting by hand.",
    "de": "Die Bestellschlange liest jeden offenen Korb, sobald die Sperre frei ist. Niemand sollte das von Hand ändern.",
    "fr": "La file des commandes lit chaque panier ouvert dès que le verrou est libre. Personne ne devrait modifier cela à la main.",
    "es": "La cola de pedidos lee cada cesta abierta en cuanto se libera el bloqueo. Nadie debería cambiar esto a mano.",
    "pt": "A fila de pedidos lê cada cesto aberto assim que o bloqueio fica livre. Ninguém deveria alterar isto à mão.",
    "it": "La coda degli ordini legge ogni cesto aperto appena il blocco è libero. Nessuno dovrebbe cambiarlo a mano.",
    "nl": "De bestelwachtrij leest elk open mandje zodra het slot vrij is. Niemand zou dit met de hand moeten wijzigen.",
}


def test_labels():
    assert [L.label(x) for x in ("en_US", " Deutsch ", "français", "ita", "pt-BR", "nld", "polish", "und", "?", "", None, "xx")] == ["en", "de", "fr", "it", "pt", "nl", "", None, None, None, None, None]


def test_sentences():
    t = "# A heading here\n\n- First item is a sentence.\n2. Is this one too?\n\n```\ncode. Not this one here.\n```\nText with `quoted words in backticks.` inside goes on. Single. foo_bar.baz()\n| a | b |\n"
    assert [" ".join(s.split()) for _, s in L.sentences(t)] == ["First item is a sentence.", "Is this one too?", "Text with inside goes on."]
    assert all(t[a : a + 5] == s[:5] for a, s in L.sentences(t)) and L.sentences("") == [] and L.sentences("```\nx") == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    v = L.train(docs.where("doc_id % 2 = 0"))
    rows = docs.where("doc_id % 2 = 1 and text is not null").collect()
    good = total = 0
    for r in rows:
        spans, named = L.sentences(r.text), L.label(r.lang)
        if spans and named:
            main = L.LANGS[int(L.score([L.plain(s) for _, s in spans], v).sum(0).argmax())]
            good, total = good + (main == named), total + 1
    assert good / total > 0.88  # labels themselves are wrong for about one in ten
    for lang, t in TEXTS.items():
        assert L.LANGS[int(L.score([L.plain(t)], v).argmax())] == lang


def test_frames(spark):
    base = [(i * 10 + k, f"{t} {t}", lang) for i in range(6) for k, (lang, t) in enumerate(TEXTS.items())]
    cases = [(901, TEXTS["de"], "fr"), (902, TEXTS["en"] + "\n\n" + TEXTS["nl"], "en"), (903, TEXTS["it"], None), (904, "", "en"), (905, None, "en"), (906, "`x.`", "?"), (907, TEXTS["es"].upper(), "Español"), (908, TEXTS["pt"], "polish")]
    df = spark.createDataFrame(base + cases, "doc_id bigint, text string, lang string").withColumn("language", F.lit(1))
    found = L.language_passages(df)
    got = sorted(tuple(r) for r in L.wrong_labels(found).where("doc_id > 900").collect())
    assert got == [(901, "de"), (902, "en"), (902, "nl"), (903, "it"), (908, "pt")]
    p = found.where("doc_id = 902").orderBy("start").collect()
    assert [x.language for x in p] == ["en", "nl"] and all(0 < x.confidence <= 1 for x in p)
    assert L.language_passages(df.limit(0)).count() == 0
