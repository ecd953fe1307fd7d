import random
import zlib

from spotlake.llm import language_id

WORDS = {"en": "the of and that with this from house water".split(), "de": "der die und nicht mit auch haus wasser über".split(), "fr": "le la les des une dans pour maison où".split(), "es": "el los una para como agua casa niño más".split()}


def docs(n=240):
    rng = random.Random(0)
    langs = list(WORDS)
    return [(i, " ".join(rng.choices(WORDS[langs[i % 4]], k=rng.randint(5, 40))), langs[i % 4], "s") for i in range(n)]


def test_held_out_accuracy(frame):
    rows = docs()
    got = {r.doc_id: r for r in language_id.identify(frame(rows)).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    assert sum(got[i].lang_pred == lang for i, _, lang, _ in rows if got[i].held_out) >= 0.97 * sum(r.held_out for r in got.values())
    assert all(0 <= r.score <= 1 for r in got.values())


def test_only_the_text_counts(frame):
    rows = docs(120)
    model = language_id.learn(frame(rows))
    a = {r.doc_id: r.lang_pred for r in language_id.predict(frame(rows), model).collect()}
    b = {r.doc_id: r.lang_pred for r in language_id.predict(frame([(i, t, "xx", "yy") for i, t, *_ in rows]), model).collect()}
    assert a == b
    assert set(model.families) == {"germanic", "romance"} and set(model.pair_svm) == {("de", "en"), ("es", "fr")}


def test_all_languages_are_learned(frame):
    rows = [(i, " ".join(f"{chr(97 + lang % 26)}{chr(97 + lang // 26)}x{chr(97 + (i * 7 + k) % 20)}" for k in range(12)), f"l{lang}", "s") for i, lang in enumerate([x % 70 for x in range(1400)])]
    model = language_id.learn(frame(rows), sample=280)
    assert sorted(c for codes in model.families.values() for c in codes) == sorted({r[2] for r in rows})


def test_odd_rows(odd, none, frame):
    got = language_id.identify(odd).collect()  # no row has a language
    assert len(got) == odd.count() and {r.lang_pred for r in got} == {"und"}
    assert language_id.identify(none).count() == 0
    some = language_id.identify(frame([*docs(60), (900, None), (901, ""), (902, "12 34 !"), (None, "le la les")])).collect()
    assert [r.lang_pred for r in some if r.doc_id in (900, 901, 902)] == ["und"] * 3
    one = language_id.identify(frame([(i, "nur eins", "de", "s") for i in range(9)])).collect()
    assert {r.lang_pred for r in one} == {"de"}


def test_keep_sure(frame):
    df = frame([*docs(60), (900, None), (902, "12 34 !")])
    out = language_id.keep_sure(df, 0.2)
    assert out.columns == df.columns and out.count() == 60


def test_keep_sure_rejects_what_no_language_is_like(frame):
    junk = ["qzxv kjwq xxzk vvqp zkqj wqxz jjkv qpzx", "a1b2c3 X9Z8 <div class=x> </td> {k:v} 0xQQ zz9", "talossa asuu vanha mies joka ei koskaan lähtenyt kylästä pois", "это русский текст о доме и воде"]
    df = frame([*docs(), *[(900 + i, t, None, "s") for i, t in enumerate(junk)]])
    kept = {r.doc_id for r in language_id.keep_sure(df, 0.2).collect()}
    assert kept == set(range(240))
