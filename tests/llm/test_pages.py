"""Operators on crawled pages: small cases for every rule, with nulls, empty tables, repeated rows and clashing names."""

import pytest

from webloom.llm import blocks, dom, encodings, forest, furniture, garbled, language, notices, screen

EN = "The river museum opened a quiet reading room on the third floor, which surprised almost everyone who had asked for it. The harbour office painted the old gate before noon."
ES = "La biblioteca municipal vendió dos litros de aceite de nuez en el tercer piso, aunque nadie lo había pedido. El club de ciclismo reparó las tejas dañadas antes del mediodía."
DE = "Der Nachtbus reparierte eine hölzerne Treppe hinter dem Rathaus, obwohl niemand darum gebeten hatte. Die Stadtbücherei verkaufte das laute Getriebe am nördlichen Ufer."
RU = "Ночной автобус починил деревянную лестницу за зданием ратуши, хотя никто об этом не просил. Городской архив продал каталог семян на северном берегу вскоре после рассвета."
TAGS = " ".join(f"[{w}{i}]" for i in range(30) for w in ("sale", "boots", "cheap lamps"))
ARTICLE = f"News | Home | Contact | Search\nThe new gate – Velby\nBy Ann Tarwick\n{EN}\n{EN.replace('river', 'town')}\nShare this story with your friends\nYou may also like\nThe old gate – Norby\nThe lamp – Oswick\n© Velby 2020 – Imprint – Privacy – Terms of use"
SCHEMA = "page_id long, url string, domain string, title string, content string, language string, k string, extra string"


def table(spark, rows):
    full = [(i, r.get("url", f"https://s{i % 3}.example/{i}"), r.get("domain", f"s{i % 3}.example"), r.get("title", "t"), r.get("content"), r.get("language", "en"), "k", "x") for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


RESIDUE = [
    "{{ title }}\nBy {{ author }}",
    f"{EN} The <%= price %> gate.",
    "Home | News\n404\nPage not found\nThe page you are looking for may have been moved or never existed.\n/12/x-y: HTTP 410",
    "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen. (ref. 1a2b3c4d5e)",
    "Lorem ipsum dolor sit amet pax vento nubes terra.\nSample heading 12-Velby",
    "Доступ запрещён\nУ вас нет прав на просмотр этой страницы.",
]
SOUND = [
    ARTICLE,
    f"{EN} In the template the editor writes {{{{ title }}}} between double braces, and the engine fills in the value.",
    f"{EN} A helpful “404 – page not found” message, the workshop explained, should always offer a way back.",
    f"{EN} The designers used lorem ipsum for the first draft and replaced every line before the launch.",
    f"{EN}\n- 12 g / 4: a recipe (on the third floor)\n- 9 g / 1: a blue sign (behind the hall)\n{EN.replace('gate', 'door')}",
    None,
    "",
    " \n\t",
]
SPAM = [TAGS, f"{EN.split('. ')[0]}.\n" + "sale, boots, cheap lamps, sale, boots, " * 20, "\n".join(f"https://s.example/sale-boots-{i}" for i in range(25)), "\n".join(f"boots Velby-{i} M 12.{i} € sale lamps" for i in range(20))]


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [{"content": c} for c in RESIDUE + SOUND] + [{"content": s} for s in SPAM for _ in range(4)]
    rows += [{"content": f"{EN.replace('river', w)} {EN.replace('gate', w)} {EN.replace('office', w)}"} for w in ("stone", "paper", "water", "north") * 6]
    return table(spark, rows)


def test_residue_and_spam(mixed):
    facts = screen.page_facts(mixed).cache()
    assert {r[0] for r in screen.residue_pages(facts).collect()} == set(range(len(RESIDUE)))
    n = len(RESIDUE) + len(SOUND)
    assert {r[0] for r in screen.spam_pages(facts).select("page_id").collect()} == set(range(n, n + 4 * len(SPAM)))
    assert screen.excluded(facts).count() == len(RESIDUE) + 4 * len(SPAM)
    none = screen.page_facts(mixed.limit(0))
    assert screen.residue_pages(none).count() == 0 and screen.spam_pages(none).count() == 0


def test_null_keys_and_domains(spark):
    big = 2**62 + 1
    rows = [(big, None, None, RESIDUE[2]), (None, None, None, RESIDUE[2]), (3, None, "t", EN), (4, "", None, encodings.garble(ES, ("utf-8", "cp1252")))]
    pages = spark.createDataFrame([(i, d, t, c, None, None) for i, d, t, c in rows], "page_id long, domain string, title string, content string, language string, url string")
    assert {r[0] for r in screen.residue_pages(screen.page_facts(pages)).collect()} == {big, None}
    assert screen.spam_pages(screen.page_facts(pages)).count() == 0
    assert {r[0] for r in garbled.find_garbled(pages).collect()} == {4}
    assert blocks.repeated_lines(pages).count() == 0


def test_wide_messages_without_a_rule(spark):
    rows = [{"content": f"Gone fishing until further notice {i}", "domain": f"d{i % 6}.example"} for i in range(12)] + [{"content": EN.replace("river", f"r{i}")} for i in range(5)]
    got = {r[0] for r in screen.residue_pages(screen.page_facts(table(spark, rows))).collect()}
    assert got == set(range(12))


POLISH = "Strona nie została znaleziona\nSprawdź adres albo wróć na początek (ref. {i})"


def test_unknown_messages_come_from_their_group(spark):
    """An error page in a language without rules, on eight sites; what articles hold or sites reprint is no message."""
    rows = [{"content": f"Home | News\n{POLISH.format(i=i)}", "domain": f"d{i}.example"} for i in range(8)]
    # A long notice on one line is grouped as well.
    notice = "Ten serwis jest chwilowo niedostępny z powodu prac technicznych i wróci, gdy tylko je zakończymy, " * 5
    rows += [{"content": notice, "domain": f"e{i}.example"} for i in range(8)]
    # Said on 200 articles of 40 sites and alone on 8 pages: only few of its pages are bare.
    rows += [{"content": f"Napisz do nas jeszcze dzisiaj\n{EN.replace('river', f'r{i}')}\n{ES.replace('club', f'c{i}')}", "domain": f"f{i % 40}.example"} for i in range(200)]
    rows += [{"content": "Napisz do nas jeszcze dzisiaj", "domain": f"f{i}.example"} for i in range(8)]
    # One article on ten sites, with a common status.
    rows += [{"content": f"{EN}\n{EN.replace('river', 'lake')}\n{EN.replace('river', 'hill')}", "domain": f"g{i}.example"} for i in range(10)]
    pages = table(spark, rows)
    assert {r[0] for r in screen.residue_pages(screen.page_facts(pages)).collect()} == set(range(16))
    # Sent with an error status, the same text is a message.
    from pyspark.sql import functions as F

    failed = pages.withColumn("status_code", F.when(F.col("domain").startswith("g"), 503).otherwise(200))
    assert {r[0] for r in screen.residue_pages(screen.page_facts(failed)).collect()} == {*range(16), *range(224, 234)}


def test_filler_words_are_learned():
    import random

    rng = random.Random(2)
    made = [f"{a}{b}" for a in ("cam", "lum", "ver", "nox") for b in ("i", "us", "em", "ae", "ora")]
    known = sorted(notices.FILLER_WORDS)
    lines = [" ".join(rng.choice(made if rng.random() < 0.8 else known) for _ in range(20)) for _ in range(60)]
    learned = notices.learn_filler([*lines, *[EN] * 50, *["cheap boots lamps sale shoes red blue green"] * 50])
    assert set(made) <= learned and not {"boots", "river"} & learned
    assert notices.message(" ".join(made), learned) == "filler" and notices.message(" ".join(made)) == ""


def test_filler_words_come_from_all_pages(spark):
    """Each word stands twice among 9,000 pages, or only in a long page; what other pages use otherwise is not learned."""
    from pyspark.sql import functions as F

    rare = [f"cam{a}{b}" for a in "bdfgklmnprst" for b in ("us", "em", "ora")]
    lines = [f"Lorem, ipsum dolor amet {' '.join(rare[i : i + 6])}." for i in range(0, len(rare), 6) for _ in range(2)]
    lines += ["lorem ipsum dolor amet noxus noxem lampae lampora"] * 3
    lines.append(f"{EN} " * 150 + "\n" + "lorem ipsum dolor amet longus longem longae longora\n" * 2)
    texts = [*lines, *["The lampae stood near the gate."] * 50]
    first = spark.createDataFrame(list(enumerate(texts)), "page_id long, content string")
    pages = first.union(spark.range(len(texts), 9000).select("id", F.lit(EN)))
    got = screen.filler_words(pages)
    assert {*rare, "longus", "longora", "lampora"} <= got and not {"lampae", "river"} & got
    assert got == notices.learn_filler(x for t in [*texts, EN] for x in t.split("\n"))
    assert screen.filler_words(pages.limit(0)) == notices.FILLER_WORDS


def test_filler_of_long_pages_has_no_main_body(spark):
    """Words that only a page of more than 20,000 characters teaches name the filler of another page, which p6 leaves out."""
    made = "longus longem longae longora pontus pontem pontae pontora"
    rows = [{"content": f"{EN} " * 150 + "\n" + f"lorem ipsum {made}\n" * 9}, {"content": made}, {"content": f"{EN}\n{ES}"}]
    facts = screen.page_facts(table(spark, rows), extra=dom.batch_marginals(dom.TreeModel()), extra_type=dom.LINES).cache()
    # An untrained model calls every line furniture, so each page that is not left out has rows.
    assert {r["page_id"] for r in dom.furniture_lines(facts, screen.excluded(facts)).collect()} == {0, 2}


def test_messages_of_any_length():
    assert notices.message("The page you are looking for is gone. " * 40) == "error"
    assert notices.message(f"{EN} {EN} It said that the page you are looking for may have been moved.") == ""


def test_masks_and_messages():
    assert notices.mask("Error 404 (ref. 9ab) at https://x.example/1 on 2024-01-02 10:00") == "error 0 at <a> on <d> <d>"
    assert notices.message("Interner Serverfehler") == "error" and notices.message(EN) == ""
    assert not notices.unfilled("“{{ x }}”") and notices.unfilled("Price: [PRICE]") and not notices.unfilled("[sale] [boots]")


def test_forest_learns_and_handles_one_class():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.random((400, 3))
    y = (x[:, 1] > 0.5).astype(int)
    p = forest.train(x, y).probability(x)
    assert ((p > 0.5) == y).mean() > 0.95
    assert forest.train(x[:3], y[:3] * 0).probability(x[:2]).tolist() == [0, 0]
    assert forest.train(x[:0], y[:0]).probability(x[:1]).tolist() == [0]


def test_forest_learns_from_all_rows(spark):
    """20 rows of 40,000 are of a kind of their own; a sample of them would hold few. The values need bins."""
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.random((40_000, 4)).astype("float32")
    x[:, 0] = x[:, 0] > 0.5
    x[:20, 2] = 50 + np.arange(20)
    y = ((x[:, 1] > 0.7) | (x[:, 2] > 1)).astype(int)
    rows = spark.createDataFrame([(i * 7919, r, c) for i, (r, c) in enumerate(zip(x.tolist(), y.tolist()))], "k long, x array<float>, y int")
    got = forest.train_table(rows)
    p = got.probability(x.astype(float))
    assert ((p > 0.5) == y).mean() > 0.99 and (p[:20] > 0.5).all()
    assert [t.tolist() for t in forest.train_table(rows.repartition(3)).trees] == [t.tolist() for t in got.trees]
    assert forest.train_table(rows.where("y = 0")).probability(x[:2].astype(float)).tolist() == [0, 0]
    assert forest.train_table(rows.limit(0)).probability(x[:1].astype(float)).tolist() == [0]


def test_every_labelled_page_trains(spark):
    facts = spark.range(20_000).selectExpr("id as page_id", "'' as domain", "cast(if(id % 2 = 0, array(0, 6, 0, 0, 0, 0, 0, 0, 0, 0, 6, 0, 0, 0, 0, 0), array(0.9, 6, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 5, 0)) as array<float>) as features")
    got = {(r["y"], r["n"]) for r in screen._labelled(facts).groupBy("y").agg({"k": "count"}).toDF("y", "n").collect()}
    assert got == {(1, 10_000), (0, 10_000)}


@pytest.mark.parametrize("transform", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1250"), ("utf-8", "cp437"), ("utf-8", "mac-roman")])
def test_round_trip_of_encodings(transform):
    for text in (ES, DE, "L’été – «là-bas» à 5 €"):
        bad = encodings.garble(text, transform)
        assert encodings.untangle(bad) == text
        assert encodings.garbled_spans(bad, encodings.Repairer())
        twice = encodings.garble(bad, transform)
        if transform[1] in ("cp1252", "latin-1"):
            assert encodings.untangle(twice) == text


@pytest.mark.parametrize("transform", [("utf-8", "cp1252"), ("utf-8", "cp1251"), ("cp1251", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r")])
def test_round_trip_of_cyrillic(transform):
    bad = encodings.garble(RU, transform)
    assert encodings.untangle(bad) == RU


def test_sound_text_stays():
    for text in (EN, ES, DE, RU, "ÄPFEL, ÖL UND ÜBUNGSRÄUME", "O cartaz dizia INFORMAÇÃO, ESTAÇÃO E PRAÇA SÃO DADAS", "An accent showed up as “Ã©” on the old display.", "НОВОСТИ И ПОГОДА", "Привет, МИР и РСФСР", "naïve façade 5 € © 2020"):
        assert encodings.garbled_spans(text, encodings.Repairer()) == [], text


def test_garbled_pages_with_twins(spark):
    g = lambda s: encodings.garble(s, ("utf-8", "cp1252"))
    rows = [{"content": f"{ES}\n{DE}"}, {"content": g(ES)}, {"content": g(DE), "title": "El tercer piso añadió dos litros"}, {"content": EN, "title": g("El tercer piso añadió dos litros")}, {"content": "caf� a"}, {"content": None, "title": None}, {"content": ""}]
    pages = table(spark, rows)
    values = garbled.suspects(pages)
    assert garbled.learn_transforms(garbled.twins(pages, values))[0] == ("utf-8", "cp1252")
    got = {(r["page_id"], r["field"]): r["restored"] for r in garbled.find_garbled(pages).collect()}
    assert got == {(1, "content"): ES, (2, "content"): DE, (3, "title"): "El tercer piso añadió dos litros", (4, "content"): None}
    assert garbled.find_garbled(pages.limit(0)).count() == 0


def test_garbled_pages_without_twins(spark):
    g = lambda s: encodings.garble(s, ("utf-8", "cp1252"))
    ru = encodings.garble(RU, ("koi8-r", "cp1251"))
    pages = table(spark, [{"content": f"{ES}\n{DE}"}, {"content": g(ES)}, {"content": g(DE)}, {"content": ru}, {"content": f"{g(DE)}\n{ru}"}, {"content": RU, "title": "НОВОСТИ И ПОГОДА"}])
    assert garbled.learn_transforms(garbled.twins(pages, garbled.suspects(pages))) [:1] == [("utf-8", "cp1252")]
    want = {1: ES, 2: DE, 3: RU, 4: f"{DE}\n{RU}"}
    assert {r["page_id"]: r["restored"] for r in garbled.find_garbled(pages).collect()} == want
    assert {r["page_id"]: r["restored"] for r in garbled.restore(pages).collect()} == want


def test_alignment_by_characters():
    for text, read in (("café à l’été", "cp1256"), ("señor über", "iso8859_7")):
        bad = text.encode().decode(read, "replace")
        assert {(x, y) for x, y in encodings.align(bad, text)} == {(y.encode().decode(read, "replace"), y) for y in text if not y.isascii()} - {("\ufffd", "x")} or "\ufffd" in bad
    assert encodings.align("añb", "añb") == encodings.align("a", "é") == []
    assert encodings.align("xńy", "xñy") == [("ń", "ñ")]


def test_garbling_outside_the_list_is_learned(spark):
    """UTF-8 read as an Arabic code page is no known transformation; twenty twins teach it."""
    g = lambda s: "".join(c if c.isascii() else c.encode().decode("cp1256") for c in s)
    lines = [f"{ES} El número {w} de la canción añadió una lección más." for w in "abcdefghijklmnopqrst"]
    assert all("\ufffd" not in g(x) for x in lines)
    pages = table(spark, [{"content": x} for x in lines] + [{"content": g(x)} for x in lines] + [{"content": g("Sin gemelo: la estación añadió otra vez el menú"), "title": g("Canción")}, {"content": "مرحبا بالعالم العربي"}])
    pairs = garbled.twins(pages, garbled.suspects(pages))
    learned = garbled.learn_maps(pairs)
    assert learned[g("ó")] == "ó" and garbled.learn_transforms(pairs) == []
    got = {(r["page_id"], r["field"]): r["restored"] for r in garbled.find_garbled(pages).collect()}
    assert got == {(20 + i, "content"): x for i, x in enumerate(lines)} | {(40, "content"): "Sin gemelo: la estación añadió otra vez el menú", (40, "title"): "Canción"}
    assert {(r["page_id"], r["field"]): r["restored"] for r in garbled.restore(pages).collect()} == got
    assert garbled.learn_maps(pairs.limit(0)) == {}


def test_lost_characters_come_from_twins(spark):
    lost = ES.encode("latin-1", "ignore").decode("utf-8", "replace")
    kept = ES.encode("latin-1", "ignore").decode("latin-1")
    pages = table(spark, [{"content": f"x\n{kept}"}, {"content": f"{lost}\nplain"}, {"content": f"{lost} more\n{lost}"}, {"content": encodings.garble(DE, ("utf-8", "cp1252"))}])
    got = {r["page_id"]: r["restored"] for r in garbled.restore(pages).collect()}
    assert got == {1: f"{kept}\nplain", 2: None, 3: DE}
    assert garbled.restore(pages.limit(0)).count() == 0


def test_repeated_lines_against_counts(spark):
    rows = []
    for i in range(40):
        body = ["  Legal  notice ", "Share this", f"line {i % 3}", f"only {i}", ""][: 3 + i % 3]
        rows.append({"domain": "big.example", "url": f"u{i % 20}", "content": "\n".join(body)})
    rows += [{"domain": "small.example", "url": f"v{i}", "content": "Share this\nLegal notice"} for i in range(7)]
    rows += [{"domain": d, "url": f"w{i}", "content": "Share this"} for i in range(9) for d in ("", None)] + [{"content": None}, {"content": "Share this", "url": None, "domain": "big.example"}]
    pages = table(spark, rows)
    seen = {}
    for r in pages.collect():
        if r["domain"] and r["content"] and r["url"]:
            for line in r["content"].split("\n"):
                s = " ".join(line.replace(" ", " ").split(" ")).strip()
                s = " ".join(x for x in s.split(" ") if x)
                if s:
                    seen.setdefault((r["domain"], s), set()).add(r["url"])
    want = {k for k, v in seen.items() if len(v) >= 8}
    found = blocks.repeated_lines(pages)
    assert {tuple(r) for r in found.collect()} == want and ("big.example", "Legal notice") in want
    cleaned = {r["page_id"]: r["content"] for r in blocks.without_blocks(pages).collect()}
    assert "Share this" not in cleaned[0] and cleaned[40] == "Share this\nLegal notice" and len(cleaned) == len(rows)
    longest = {len(r["block"]) for r in blocks.repeated_blocks(pages).collect()}
    assert 2 in longest
    assert blocks.repeated_lines(pages.limit(0)).count() == 0


def test_interval_counts_do_not_depend_on_the_tasks(spark):
    rows = [{"domain": f"d{i % 2}.example", "url": f"u{i}", "content": "\n".join(["a", "b", "c"][: 1 + i % 3] * 2)} for i in range(60)]
    pages = table(spark, rows)
    whole = sorted((r["site"], tuple(r["block"]), r["n"]) for r in blocks.repeated_blocks(pages).collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert sorted((r["site"], tuple(r["block"]), r["n"]) for r in blocks.repeated_blocks(pages).collect()) == whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_long_blocks_count_urls(spark):
    long = [f"l{j}" for j in range(9)]
    rows = [{"domain": "a.example", "url": f"u{i}", "content": "\n".join([f"own {i}", *long, f"end {i}"])} for i in range(8)]
    # Seven urls, one of them crawled again, and a page that says it twice: eight places and more, but no eight urls.
    rows += [{"domain": "b.example", "url": f"u{i % 7}", "content": "x\ny\nz\nx\ny"} for i in range(9)]
    # Eight urls have each line, but only seven the pair.
    rows += [{"domain": "c.example", "url": f"u{i}", "content": "p\nq\np\nq" if i < 7 else "p\n-\nq"} for i in range(8)]
    got = [(r["site"], len(r["block"]), r["n"]) for r in blocks.repeated_blocks(table(spark, rows)).collect()]
    assert sorted(got) == sorted([("a.example", d, 8) for d in range(1, 10) for _ in range(10 - d)] + [("c.example", 1, 8)] * 2)


def test_whole_blocks_carry_the_lines(spark):
    """Lines come out of the longest blocks on as many urls: only those are left, and without blocks nothing is."""
    rows = [{"domain": "a.example", "url": f"u{i}", "content": "\n".join([f"own {i}", "l", "m", "n", f"end {i}", *(["m"] if i < 3 else [])])} for i in range(9)]
    rows += [{"domain": "a.example", "url": "u99", "content": "m"}]
    pages = table(spark, rows)
    found = blocks.repeated_blocks(pages)
    whole = sorted((len(r["block"]), r["n"]) for r in blocks.whole_blocks(found).collect())
    # l-m-n on nine urls, and m alone on ten.
    assert whole == [(1, 10), (3, 9)] and found.count() == 6
    assert {r["line"] for r in blocks.repeated_lines(pages).collect()} == {"l", "m", "n"}
    assert blocks.block_lines(blocks.whole_blocks(found).limit(0)).count() == 0
    got = {r["page_id"]: r["content"] for r in blocks.without_blocks(pages).collect()}
    assert got[0] == "own 0\nend 0" and got[9] == ""


def test_hot_site_is_split_with_the_same_rows(spark, monkeypatch):
    from webloom.operators import skew

    rows = [{"domain": "hot.example", "url": f"u{i}", "content": f"foot\nline {i % 7}\nown {i}"} for i in range(120)] + [{"domain": f"d{i % 9}.example", "url": f"v{i}", "content": "foot\nx"} for i in range(90)]
    pages = table(spark, rows)
    want = sorted(map(tuple, blocks.repeated_lines(pages).collect()))
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(skew, "HOT_KEYS", 10)
    assert sorted(map(tuple, blocks.repeated_lines(pages).collect())) == want and len(want) == 8 + 18


def test_label_codes():
    assert [language.label_code(x) for x in ("en", "EN", "en-US", "es_AR", "eng", "deu", "und", "xx", "", None, "unknown", "nl")] == ["en", "en", "en", "es", "en", "de", None, None, None, None, None, "nl"]


def test_words_come_from_all_pages(spark, monkeypatch):
    """The same model as from all rows at once; a page of more than 20,000 characters teaches too, and so do two pages among 9,000."""
    import numpy as np

    monkeypatch.setattr(language, "PACK_SIZE", 100)
    rare = EN.replace("river", "zwelby").replace("museum", "tarnoq")
    rows = [("en", EN), ("es", ES), ("de", DE), ("ru", RU), ("es", EN), (None, DE), ("en", rare), ("en-GB", rare), ("xx", RU), ("de", f"{DE} gorlund " * 200), ("en", None), ("en", "")]
    first = spark.createDataFrame(rows, "language string, content string")
    got, want = language.train_table(first), language.train(rows)
    words = {w.strip(language._STRIP) for _, c in rows if c for w in c.lower().split()}
    for w in words | {"gorlund", "zwelby", "unheard"}:
        a, b = got.table.get(w), want.table.get(w)
        assert (a is None) == (b is None) and (a is None or np.allclose(a, b)), w
    assert got.ends.keys() == want.ends.keys() and all(np.allclose(x, want.ends[e]) for e, x in got.ends.items())
    many = spark.range(9000).selectExpr("id as page_id", "'en' as language", f"'{EN}' as content")
    model = language.train_table(first.union(many.select("language", "content")))
    assert all(model.table.get(w) is not None for w in ("tarnoq", "gorlund", "zwelby"))
    assert language.train_table(many.limit(0)).table == {}


@pytest.fixture(scope="module")
def model():
    return language.train([("en", EN), ("es", ES), ("de", DE), ("ru", RU), ("fr", "Le bus de nuit a réparé un escalier en bois derrière la mairie, alors que personne ne l’avait demandé à la bibliothèque.")] * 3 + [("es", EN), (None, DE)])


def test_lines_and_spans(model):
    got = language.Labeller(model).lines([EN, ES, DE, RU, f"{EN} {DE}", f"{EN} {EN} la biblioteca municipal", "12 34 – 56"])
    assert [g[0] for g in got[:4]] == ["en", "es", "de", "ru"]
    assert {s[2] for s in got[4][2]} == {"en", "de"} and got[5][0] == "en"
    assert all(0 <= g[1] <= 1 for g in got)
    assert language.Labeller(model).lines([]) == []
    (x, y, _, c), *rest = got[4][2]
    assert x == 0 and rest[-1][1] == len(f"{EN} {DE}".split()) and all(0.5 < s[3] <= 1 for s in got[4][2]) and abs(y - len(EN.split())) <= 3


FAR = {
    "zh": "市立图书馆在三楼开设了一间安静的阅览室，许多居民感到十分惊讶，港口办公室在中午之前粉刷了旧大门，" * 3,
    "ja": "市立図書館は三階に静かな閲覧室を開き、多くの人々を驚かせました。港の事務所は正午までに古い門を塗りました。" * 3,
    "el": "Η δημοτική βιβλιοθήκη άνοιξε μια νέα αίθουσα ανάγνωσης στον τρίτο όροφο κοντά στο παλιό λιμάνι της πόλης",
    "ar": "افتتحت المكتبة البلدية قاعة قراءة جديدة في الطابق الثالث من المبنى القديم بالقرب من الميناء القديم للمدينة",
    "und": "Gemeentelijke bibliotheek heeft onlangs een nieuwe leeszaal geopend bovenop het oude gebouw vlakbij jullie haven",
}


def test_other_languages_are_not_forced_into_the_seven(spark, model):
    got = language.Labeller(model).lines([*FAR.values(), f"{EN} {FAR['el']}"])
    assert [g[0] for g in got[:5]] == list(FAR) and [s[2] for s in got[5][2]] == ["en", "el"]
    labels = ["zh-TW", "ja", "el", "fa", "nl", "en", None]
    rows = [{"content": t, "language": x} for t, x in zip([*FAR.values(), FAR["el"], FAR["und"]], labels)]
    facts = screen.page_facts(table(spark, rows), extra=language.batch_labeller(model), extra_type=language.LINES).cache()
    assert [(r["page_id"], r["language"]) for r in language.wrong_labels(facts, screen.residue_pages(facts)).collect()] == [(5, "el")]
    lines = {r["page_id"]: r["language"] for r in language.line_languages(facts).collect()}
    assert lines == {0: "zh", 1: "ja", 2: "el", 3: "fa", 4: "und", 5: "el", 6: "und"}


def test_segments_of_mixed_lines(spark, model):
    pages = table(spark, [{"content": f"x\n{EN} {DE}"}, {"content": ES}, {"content": None}])
    facts = screen.page_facts(pages, extra=language.batch_labeller(model), extra_type=language.LINES)
    got = sorted(tuple(r)[:5] for r in language.line_segments(facts).collect())
    assert [(g[0], g[1], g[4]) for g in got] == [(0, 1, "en"), (0, 1, "de"), (1, 0, "es")]
    assert got[0][3] == got[1][2] and got[1][3] == len(f"{EN} {DE}".split()) and got[2][2:4] == (0, len(ES.split()))


def test_lines_of_the_site_make_no_mixed_page(spark, model):
    rows = [{"content": f"{EN.replace('river', f'r{i}')}\n{DE}", "domain": "a.example"} for i in range(2)] + [{"content": f"{EN}\n{ES}", "domain": "a.example"}]
    facts = screen.page_facts(table(spark, rows), extra=language.batch_labeller(model), extra_type=language.LINES).cache()
    assert {r["page_id"] for r in language.wrong_labels(facts, screen.residue_pages(facts)).collect()} == {2}
    # One url crawled twice is one place.
    again = table(spark, [{"content": f"{EN}\n{EN}\n{DE}", "domain": "a.example", "url": "u"}] * 2)
    facts = screen.page_facts(again, extra=language.batch_labeller(model), extra_type=language.LINES)
    assert {r["page_id"] for r in language.wrong_labels(facts.cache(), screen.residue_pages(facts)).collect()} == {0, 1}


def test_wrong_labels(spark, model):
    rows = [{"content": f"x\n{EN}", "language": "en-GB"}, {"content": EN, "language": "de"}, {"content": f"{EN}\n\n{ES}\n{EN}", "language": "en"}, {"content": EN, "language": None}, {"content": "short", "language": None}, {"content": None}, {"content": "404\nPage not found", "language": None}, {"content": f"{DE}\n{DE}", "language": "DE"}]
    pages = table(spark, rows)
    facts = screen.page_facts(pages, extra=language.batch_labeller(model), extra_type=language.LINES).cache()
    got = sorted((r["page_id"], r["line_no"], r["language"]) for r in language.wrong_labels(facts, screen.residue_pages(facts)).collect())
    assert got == [(1, 0, "en"), (2, 0, "en"), (2, 2, "es"), (2, 3, "en"), (3, 0, "en")]
    assert {r["page_id"]: r["language"] for r in language.page_languages(facts).collect()} == {0: "en", 1: "en", 2: "en", 3: "en", 7: "de"}


def test_every_page_has_a_row(spark, model):
    words = "\n".join(DE[i : i + 70] for i in range(0, len(DE), 70))
    rows = [{"content": EN}, {"content": words, "language": "deu"}, {"content": None, "language": "ES-ar"}, {"content": ""}, {"content": " \n"}, {"content": "12 – 34"}, {"content": f"{EN}\n{ES}\n{EN}"}, {"content": "Городской архив"}]
    pages = table(spark, rows)
    facts = screen.page_facts(pages, extra=language.batch_labeller(model), extra_type=language.LINES).cache()
    got = {r["page_id"]: r for r in language.all_page_languages(facts, pages).collect()}
    assert {i: r["language"] for i, r in got.items()} == {0: "en", 1: "de", 2: None, 3: None, 4: None, 5: None, 6: "en", 7: "ru"}
    assert got[2]["label"] == "es" and got[1]["n_lines"] == 0 and got[6]["n_languages"] == 2
    assert all((r["confidence"] is None) == (r["language"] is None) for r in got.values())
    assert sorted((r["page_id"], r["line_no"]) for r in language.line_languages(facts).collect()) == [(0, 0), (6, 0), (6, 1), (6, 2)]


def test_kinds_of_lines():
    want = ["nav", "", "byline", "", "", "share", "head", "point", "point", "foot"]
    assert furniture.kinds(furniture.page_lines(ARTICLE)) == want
    lost = "Startseite | Galerie | �ber uns\n� Velby 2020 � Impressum � Datenschutz"
    assert furniture.kinds(furniture.page_lines(lost)) == ["nav", "foot"]
    assert furniture.kinds(furniture.page_lines("Véase también: X\nWeather\nNew")) == ["point", "nav", ""]
    assert furniture.page_lines(None) == [] and len(furniture.page_lines("a\n\n b ")) == 3


def pages_of_sites(n):
    """Articles of several sites: (domain, title, lines)."""
    out = []
    for i in range(n):
        town = ("Norby", "Tarwick", "Oswick", "Halby", "Senby", "Marby")[i % 6] + "fgh"[i % 3]
        town += "".join("abcdefghij"[int(d)] for d in str(i))
        site = f"velby{i % 5}"
        text = ARTICLE.replace("The new gate – Velby", f"The gate {i} – {town}").replace("The old gate – Norby", f"Old {i} – {town}").replace("The lamp – Oswick", f"Lamp {i} – {town}")
        text = text.replace("Ann Tarwick", f"Ann {town}").replace("river", town.lower()).replace("© Velby", f"© {site.title()}")
        out.append((f"{site}.example", f"The gate {i} – {town}", furniture.page_lines(text)))
    return out


@pytest.fixture(scope="module")
def tree():
    return dom.train(pages_of_sites(80) + [("x.example", "t", [EN, ES, DE])] * 5, {})


def test_trees_of_pages():
    t = dom.page_tree(["A | B | C", "", "Heading", EN, "Things:", "- one", "- two", "2) three", "Next"], "Heading")
    lines = ["A | B | C", "Heading", EN, "Things:", "- one", "- two", "2) three", "Next"]
    assert t.texts == lines and [t.edge[i] for i in t.line] == [dom.ROOT, dom.NEXT, dom.BLOCK, dom.BLOCK, dom.ITEM, dom.ITEM, dom.ITEM, dom.NEXT]
    parents = {lines[k]: (t.texts[t.line.index(t.parent[i])] if t.parent[i] >= 0 else None) for k, i in enumerate(t.line)}
    assert parents == {"A | B | C": None, "Heading": "A | B | C", EN: "Heading", "Things:": "Heading", "- one": "Things:", "- two": "Things:", "2) three": "Things:", "Next": "Heading"}
    assert [t.parent[i] for i in range(len(t.parent)) if t.edge[i] == dom.ENTRY] == [0, 0, 0]
    assert dom.page_tree([], "").parent == dom.page_tree(["", ""], None).parent == []
    assert dom.site_name("www.velby0.example") == "velby0" and dom.site_name("", "https://docs.velby-shop.test/x") == "velby-shop" and dom.site_name(None, None) == ""


def test_labels_come_from_repetition():
    pages = pages_of_sites(60)
    labels = dom.Labels(pages, {})
    got = [dom.STATES[i] for i in labels.states(*pages[0])]
    assert got == ["return", "title", "byline", "text", "text", "return", "head", "point", "point", "return"]


def test_marginals_are_exact(tree):
    import itertools

    import numpy as np

    t = dom.page_tree(["News | Home | Contact", "The gate 3 – Halbyfd", EN, "- one"], "x")
    u = tree.unary([t])[0]
    n = len(t.parent)
    z, top = np.zeros((n, dom.K)), None
    # A few states only, so that all paths can be tried.
    some = range(3)
    small = dom.TreeModel()
    small.node, small.pair = tree.node, np.full_like(tree.pair, -50.0)
    small.pair[:, :3, :3] = tree.pair[:, :3, :3]
    small.pair[dom.ROOT, 0, :3] = tree.pair[dom.ROOT, 0, :3]
    for path in itertools.product(some, repeat=n):
        w = sum(u[i][s] for i, s in enumerate(path)) + sum(small.pair[dom.ROOT, 0, s] if t.parent[i] < 0 else small.pair[t.edge[i], path[t.parent[i]], s] for i, s in enumerate(path))
        for i, s in enumerate(path):
            z[i, s] += np.exp(w)
    want = z / z.sum(1, keepdims=True)
    assert np.allclose(small.beliefs([t])[0], want, atol=1e-6)
    b, both, _, _ = small.beliefs([t, dom.page_tree([EN], "")], pairs=True)
    for i, p in enumerate(t.parent):
        if p >= 0:
            assert np.allclose(both[i].sum(0), b[i], atol=1e-6) and np.allclose(both[i].sum(1), b[p], atol=1e-6)
    assert [len(m) for m in tree.marginals([dom.page_tree([], ""), t])] == [0, 4]
    # The entries may tell their lines first: the lines' marginals are the same.
    more = [t, dom.page_tree(["x", "A | B | C | D", EN], ""), dom.page_tree(["a · b · c", "a / b / c", "z"], "")]
    for tr, m in zip(more, tree.marginals(more)):
        assert np.allclose(m, tree.beliefs([tr])[0][tr.line, : dom.MAIN].sum(1))


def test_main_body(spark, tree):
    lines = pages_of_sites(91)[90]
    pages = table(spark, [{"content": "\n".join(lines[2]), "title": lines[1], "domain": lines[0]}, {"content": f"\n{EN}\n"}, {"content": None}, {"content": " \n "}])
    facts = screen.page_facts(pages, extra=dom.batch_marginals(tree), extra_type=dom.LINES)
    found = dom.furniture_lines(facts, screen.residue_pages(facts)).cache()
    assert sorted((r["page_id"], r["line_no"]) for r in found.collect()) == [(0, i) for i in (0, 2, 5, 6, 7, 8, 9)]
    body = {r["page_id"]: r["main"] for r in dom.main_bodies(pages, found).collect()}
    assert body[0].split("\n") == [lines[2][i] for i in (1, 3, 4)] and body[1] == f"\n{EN}\n" and body[2] is None


def test_returns_are_counted_over_all_pages(spark):
    rows = [{"content": f"Menu  line\nown {i}", "url": f"u{i % 4}", "domain": "a.example"} for i in range(9)] + [{"content": "Menu line", "domain": "b.example"}, {"content": None}]
    pages = table(spark, rows)
    picked = pages.where("page_id < 2").select("domain", "title", "content").collect()
    assert dom.site_urls(pages, picked) == {("a.example", "Menu line"): 4}
    assert dom.site_urls(pages, []) == {}
    model = dom.learn(pages.limit(0))
    assert model.marginals([dom.page_tree(["x"], "")])[0].shape == (1,)


def test_page_model_comes_from_all_pages(spark):
    """Pages of more than 20,000 characters teach the model of p6 as well, and states come from the returns on all pages."""
    import numpy as np

    given = pages_of_sites(60)
    rows = [(d, t, [*lines[:4], " ".join([lines[4]] * 150), *lines[5:]]) for d, t, lines in given] + [("", "A | B | C", ["A | B | C", "x", "", "1. y", f"Note: {EN}"])]
    pages = table(spark, [{"domain": d, "title": t, "content": "\n".join(lines)} for d, t, lines in rows]).repartition(3)
    facts = screen.page_facts(pages, extra=dom.batch_trees(), extra_type=dom.TREES).cache()
    trees = dom.trees_of(facts)
    found, labels = dom.Returns(trees), dom.Labels([r for r in rows if dom.sound(r[2])], {})
    assert found.n == labels.n and len(found.wide) == len(labels.wide) and len(found.heads) == len(labels.heads) > 0
    got = {}
    for r in trees.toArrow().to_batches():
        for keys, p in zip(r.column("pages"), dom.Packed.rows(iter([r]))):
            y = found.states(p)
            got |= {int(k.as_py()): y[p.of == i].tolist() for i, k in enumerate(keys.values)}
    assert got == {i: labels.states(*r) for i, r in enumerate(rows)}
    model = dom.learn(pages)
    own = dom.page_tree(given[7][2], given[7][1], "velby2")
    assert [x >= 0.5 for x in model.marginals([own])[0]] == [i in (1, 3, 4) for i in range(10)]
    # The packed trees give the marginals of the trees.
    lines = dom.furniture_lines(dom.marked_pages(trees, model), pages.limit(0)).collect()
    want = screen.page_facts(pages, extra=dom.batch_marginals(model), extra_type=dom.LINES)
    want = dom.furniture_lines(want, pages.limit(0)).collect()
    assert sorted(r[:2] for r in lines) == sorted(r[:2] for r in want) and np.allclose([r[2] for r in sorted(lines)], [r[2] for r in sorted(want)], atol=1e-5)


def test_gradient_of_packed_trees(spark):
    """Packed trees have the gradient of the plain ones."""
    import numpy as np

    rows = pages_of_sites(3)
    facts = screen.page_facts(table(spark, [{"domain": d, "title": t, "content": "\n".join(x)} for d, t, x in rows]).coalesce(1), extra=dom.batch_trees(), extra_type=dom.TREES)
    (p,) = dom.Packed.rows(iter(dom.trees_of(facts).toArrow().to_batches()))
    rng = np.random.default_rng(2)
    model = dom.TreeModel()
    model.node += rng.normal(0, 0.3, model.node.shape).astype("float32")
    model.pair += rng.normal(0, 0.3, model.pair.shape)
    y = rng.integers(0, dom.K, len(p.node)).astype("int8")
    p = dom.Packed(p.some(np.arange(3), y))
    node, pair = dom._gradient(p, model)
    trees = [dom.page_tree(x, t, dom.site_name(d)) for d, t, x in rows]
    states, lines = [], iter(y.tolist())
    for t in trees:
        own = [next(lines) if e != dom.ENTRY else -1 for e in t.edge]
        states += [own[i] if s < 0 else s for s, i in zip(own, t.parent)]
    b, both, flat, owner = model.beliefs(trees, pairs=True)
    b[np.arange(len(b)), states] -= 1
    want = np.zeros_like(node)
    np.add.at(want, flat, b[owner])
    assert np.allclose(node, want, atol=1e-4)
    edge = np.concatenate([t.edge for t in trees])
    first = np.repeat(np.cumsum([0] + [len(t.edge) for t in trees])[:-1], [len(t.edge) for t in trees])
    up = np.concatenate([t.parent for t in trees]) + first
    states = np.array(states)
    for e in range(1, dom.EDGES):
        on = edge == e
        right = both[on].sum(0)
        np.subtract.at(right, (states[up[on]], states[on]), 1)
        assert np.allclose(pair[e], right, atol=1e-4)
    assert np.allclose(pair[dom.ROOT, 0], b[edge == dom.ROOT].sum(0), atol=1e-4)


def test_lines_are_prepared_once(monkeypatch):
    """p6 doesn't mask a line that its tree has masked, and each garbled sequence of a text is decoded once."""
    import pyarrow as pa

    lines = ["News | Home | Contact | Search", "", "The gate 12 – Velby", EN, f"{EN} Velby, 3٣", "- one", "Things: a", "News | Home | Contact | Search"]
    sites, masked, calls = ["velby", "velby2", "norby"], dom.masked, []
    given = [[x.replace("Velby", s.title()) for x in lines] for s in sites]
    monkeypatch.setattr(dom, "masked", lambda s, site: calls.append(site) or masked(s, site))
    lows = [[x.lower() for x in page] for page in given]
    page = {"k": ["a", "b", "c"], "domain": [f"www.{s}.example" for s in sites], "title": ["t", None, "Things: a"]}
    got = dom.batch_trees()()(page, given, [[x.split() for x in low] for low in lows], lows)
    # Numbers in the site's own name are masked before it, so only those lines are masked by themselves.
    assert set(calls) == {"velby2"}
    (p,) = dom.Packed.rows(iter([pa.RecordBatch.from_struct_array(got.drop_null())]))
    kept = [(x, s) for page, s in zip(given, sites) for x in page if x]
    assert p.mark[p.node].tolist() == [dom._hash(masked(x, s)) for x, s in kept]
    assert p.flag(dom.SHORT).tolist() == [dom.is_short(x) for x, _ in kept] and p.flag(dom.LISTED).tolist() == [x == "- one" for x, _ in kept]
    assert p.flag(dom.OWN).tolist() == [s == "norby" and x == "Things: a" for x, s in kept] and p.flag(dom.PARTED).tolist() == ["|" in x for x, _ in kept]
    names = [e.lower() for x, _ in kept for e in dom.entries(x)]
    assert p.mark[p.part].tolist() == list(map(dom._hash, names)) and [kept[i][0] for i in p.line] == [lines[0]] * len(names)

    ungarble, runs = encodings.ungarble, []
    monkeypatch.setattr(encodings, "ungarble", lambda s, t: runs.append((s, t)) or ungarble(s, t))
    text = " ".join(["niÃ±o", "aÃ±o", "Ã¡rbol", "seÃ±or"] * 5)
    assert encodings.untangle(text) == " ".join(["niño", "año", "árbol", "señor"] * 5)
    assert sorted(r for r, t in runs if t == ("utf-8", "cp1252")) == ["Ã¡", "Ã±"]


def test_beliefs_of_far_potentials():
    """Potentials that lie thousands apart, as those of very long lines may, neither overflow nor vanish."""
    import numpy as np

    model = dom.TreeModel()
    u = np.zeros((3, dom.K))
    u[0, 1], u[1, 2], u[2, 3] = 3000, -4000, 5000
    b, both = model._sum_product(u, np.array([3]), np.array([-1, 0, 1]), np.array([dom.ROOT, dom.NEXT, dom.BLOCK]), True)
    assert np.isfinite(b).all() and np.isfinite(both).all() and np.allclose(b.sum(1), 1) and np.allclose(both[1:].sum((1, 2)), 1)
    assert b[0].argmax() == 1 and b[1, 2] == 0 and b[2].argmax() == 3
