"""Wrong encodings: round trips, decoys, partial damage."""

import pytest

from granthika.llm.encoding import repair, restore

HINDI = "मालजीलीगढ़ नगर तालयामोगाँव से 139.30 कि.मी. दूर नदी के किनारे पर स्थित है।"
URDU = "نرلیناکوٹ کا گےہوں 170.72 ر. پرت کلو بکتا ہے۔"
ENGLISH = "Sinpikeganj’s élite met at the “Tirchlogarh” hall — €310…"


def garble(text, codec):
    out = []
    for b in text.encode():
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("codec", ["latin-1", "cp1252", "cp1251", "mac_roman", "cp437"])
@pytest.mark.parametrize("text", [HINDI, ENGLISH, URDU])
def test_round_trip(text, codec):
    g, fixed, steps, _, lost = repair(garble(text, codec))
    assert g and fixed == text and lost == 0 and steps


def test_arabic_code_page():
    g, fixed, steps, _, _ = repair(garble(HINDI, "cp1256"))
    assert g and fixed == HINDI


def test_twice_and_in_part():
    assert repair(garble(garble(HINDI, "cp1252"), "cp1252"))[1] == HINDI
    assert repair(garble(garble(ENGLISH, "latin-1"), "cp1252"))[1] == ENGLISH
    part = HINDI + " " + garble(HINDI, "mac_roman") + " “café”"
    assert repair(part)[:2] == (True, HINDI + " " + HINDI + " “café”")
    assert repair("टिकट в‚№1,252 है")[:2] == (True, "टिकट ₹1,252 है")
    assert repair("a &amp; b &#2325;")[1] == "a & b क"


def test_five_times():
    for codecs in (["cp1252"] * 5, ["latin-1"] * 6, ["cp1252", "latin-1", "cp1252", "mac_roman", "cp1252"]):
        t = HINDI
        for c in codecs:
            t = garble(t, c)
        assert repair(t)[1] == HINDI


def test_parts_in_different_encodings():
    parts = [HINDI, URDU, ENGLISH, HINDI[::-1]]
    t = " ".join(garble(p, c) for p, c in zip(parts, ["cp1252", "cp1251", "mac_roman", "cp437"]))
    assert repair(t + " " + HINDI)[1] == " ".join([*parts, HINDI])


@pytest.mark.parametrize("read,written,text", [("cp1252", "cp1251", "Привет, Москва"), ("latin-1", "cp1251", "Документ получен вчера"), ("cp1252", "cp1253", "Καλημέρα")])
def test_single_byte_against_single_byte(read, written, text):
    assert repair("see " + text.encode(written).decode(read))[:2] == (True, "see " + text)


def test_escapes_and_east_asian():
    from urllib.parse import quote

    assert repair("x " + quote("हिन्दी"))[:2] == (True, "x हिन्दी")
    assert repair("x \\u0939\\u093f 100% \\xe0\\xa4\\x95")[:2] == (True, "x हि 100% क")
    assert repair("&amp;amp; caf&amp;eacute;")[1] == "& café"
    assert repair("देश".encode().decode("gbk", "replace"))[0]
    assert repair("a%20b 50%50% C:\\users\\x42")[0] is False and repair("日本語の文章です")[0] is False


def test_very_long_garbled_text():
    t = " ".join(garble(garble(f"{HINDI} {i}", "cp1252"), "mac_roman") for i in range(2000))
    assert repair(t)[1] == " ".join(f"{HINDI} {i}" for i in range(2000))


def test_a_single_quotation_mark():
    assert repair("he said вЂњyes")[:2] == (True, "he said “yes")


def test_lost_characters():
    g, fixed, _, _, lost = repair("The cafÃ� and à¤�à¤® x")
    assert g and lost >= 1
    assert repair("â��Itâ��s")[0]


@pytest.mark.parametrize("t", ["the village of Ãlvora asked, Àrvë’s café", "© Kelvîn Ârçâ “Ça va”, Élodre", "30 °C ± ½", "a señal of Óbrida", "Привелов का मेला", "Đorvač Zürnäch Tâmis-le-Vœr São Virão Møllsø Ñuvië", HINDI, URDU, ENGLISH, "", "plain", "naïf façade «x»", None])
def test_genuine(t):
    assert repair(t)[:2] == (False, t)


def test_operator(spark):
    rows = [(1, garble(HINDI, "cp1252"), "a"), (1, garble(HINDI, "cp1252"), "a"), (2, HINDI, None), (3, None, None), (4, "", None), (5, URDU, None), (6, garble(URDU, "latin-1"), None), (7, garble(HINDI, "cp1251") * 200, None), (8, "Привелов", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, steps string")
    got = restore(df, "text", "doc_id").collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 6, 7]
    assert {r.doc_id: r.restored_text for r in got} == {1: HINDI, 6: URDU, 7: HINDI * 200}
    assert restore(df.limit(0), "text", "doc_id").count() == 0
