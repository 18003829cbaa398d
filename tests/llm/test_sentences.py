"""Sentence boundaries: cases by hand, and properties of any text."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granthika.llm.sentences import sentences, spans


def split(t):
    return [t[a:b] for a, b in spans(t)]


@pytest.mark.parametrize(
    "parts",
    [
        ["वर्षा 65.1 से.मी. तक पहुँची।", "1793 में श्री आर. आए।"],
        ["डॉ. ए. वसका 12.5 कि.मी. दूर गए।", "दूसरा वाक्य है॥ ४९ ॥", "तीसरा है |", "चौथा है"],
        ['जब पूछा गया, "क्या यह सुरक्षित है?" तब कै. पारभाश्वाल ने X.V.S. का रिकॉर्ड दिखाया।', 'के. गोल ने कहा, "बाग़ चाहिए।"', "1855 में मंदिर बंद था।"],
        ["12. KAAX संस्था ने मापी।", "11. 1781 की बाढ़ थी।"],
        ["«मेला शुरू होता है।»", "(कै. पार ने लिखा है।)", "नगर दूर है!!", "क्या??"],
        ["यह... बड़ा है।", "संस्था ए.... ने मापी।"],
        ["1697 مےں اوڈھنیگھر بںد ہوا۔", "درشی ہے؟", "شری وی. پار کو 47.60 م.گرا. ملا۔"],
        ["Capt. A. Gole found 3.5 mg. per litre, e.g. iron.", "When asked, “Is it safe?”, he left.", "“It is so.” ", "It cost ₹1,000 in 1959.", "No. 5 won!"],
    ],
)
def test_by_hand(parts):
    if parts[-1].startswith("No. 5"):
        parts = [p.strip() for p in parts]
    assert split(" ".join(parts)) == parts


@pytest.mark.parametrize(
    "lang,parts",
    [
        ("hi", ["यह काम किया गांधी जी.", "वे चले गये.", "फिर आये."]),
        ("hi", ["श्री जी. मोद ने कहा.", "जी. के. गोल आये.", "डॉ. पी. राव गये."]),
        ("mr", ["ही माझी आई.", "ती आली."]),
        ("pa", ["ਪੁਲ 1811 ਤੋਂ ਪਹਲੇ ਬਨਾ ਸੀ.", "ਸੁਸ਼੍ਰੀ ਸੀ. ਜੁਨ ਗਏ."]),
        ("en", ["The answer was No.", "We left at once."]),
        ("en", ["It was No. 5 of Vol. II.", "He came in Mar. 1990 to see Dr. Roy.", "This is the end of Mar.", "Good."]),
        (None, ["यह काम किया गांधी जी.", "वे चले गये."]),
        ("xx", ["डॉ. ए. वसका गए।", "ডাঃ চলে গেলেন।"]),
    ],
)
def test_by_language(lang, parts):
    t = " ".join(parts)
    assert [t[a:b] for a, b in spans(t, lang)] == parts


def test_short_forms_are_those_of_the_language():
    t = "এটি রু. নয়"
    assert len(spans(t, "bn")) == 1 and len(spans(t, "hi")) == 2 and len(spans(t, None)) == 1


def test_a_long_word_that_ends_like_a_short_form():
    t = "यह एक बात है और " + "क" * 30 + "डॉ. फिर कुछ और बात है"
    assert len(spans(t, "hi")) == 2 and len(spans("((((((((((((((((((((((((((((((डॉ. फिर", "hi")) == 1


def test_without_spaces_between():
    assert split("मापी।2004 की बाढ़ आई।जब पूछा गया।") == ["मापी।", "2004 की बाढ़ आई।", "जब पूछा गया।"]
    t = "डॉ.हीरराने40.5कि.मी.सड़कसुधारी।\"यहबड़ाहै।\"सुश्रीआर.मोदनेकहाऔरगए।"
    assert split(t) == ["डॉ.हीरराने40.5कि.मी.सड़कसुधारी।", '"यहबड़ाहै।"', "सुश्रीआर.मोदनेकहाऔरगए।"]


def test_spaces_between_sentences_only():
    t = "वसमोपुरऔरलकनगरकेबीच7,87,486कि.मी.सड़कसुधारीगईऔरखुली। डॉ.ए.गोलनेमईमें12.35रु.प्रतिकिलोकाभावलिखा।\nप्रो.आर.कुमनेकहा"
    assert split(t) == [t[: t.index(" डॉ")], t[t.index("डॉ") : t.index("\n")], t[t.index("प्रो.आर") :]]


def test_verse_number_between_two_dandas():
    assert split("गहराई मापी गई ।। ४५ ।। दूसरा वाक्य है।। तीसरा") == ["गहराई मापी गई ।। ४५ ।।", "दूसरा वाक्य है।।", "तीसरा"]


def test_unseen_signs_and_split_letters():
    t = "6112 कि.\u200bमी. सड़क सुधारी। प\u200b्रो. अार. ने लिखा।"
    assert len(spans(t)) == 2 and t[spans(t)[1][0]] == "प"


def test_nothing():
    assert spans(None) == [] == spans("") == spans(" \n\u00a0 ")
    assert split("  no end  ") == ["no end"]
    assert len(spans("...")) == 1 and len(spans('"।"')) == 1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab A1।.!?|॥\"'”“()…, \nकि.मीडॉ४\u200b\u00a0", max_size=60))
def test_spans_cover_the_text(t):
    s = spans(t)
    assert all(a < b for a, b in s) and all(x[1] <= y[0] for x, y in zip(s, s[1:]))
    covered = {i for a, b in s for i in range(a, b)}
    assert all(t[i].isspace() for i in range(len(t)) if i not in covered) or not t.strip()
    assert not s or not t[s[0][0]].isspace()


def test_very_long_text():
    t = "यह एक वाक्य है। " * 20_000
    assert len(spans(t)) == 20_000
    assert len(spans("क" * 300_000)) == 1


def test_operator(spark):
    df = spark.createDataFrame([(1, "एक है। दो है।", "x"), (1, "एक है। दो है।", "x"), (2, None, "y"), (3, " ", None)], "id bigint, text string, sentence string")
    got = sorted(tuple(r) for r in sentences(df, "text", "id").collect())
    by_lang = spark.createDataFrame([(1, "ही आई. ती", "mr"), (2, "ही आई. ती", None), (3, None, "mr")], "id bigint, text string, lang string")
    assert sorted((r.id, r.start_char) for r in sentences(by_lang, "text", "id", lang="lang").collect()) == [(1, 0), (1, 7), (2, 0), (2, 7)]
    assert got == sorted([(1, 0, 0, 6, "एक है।"), (1, 1, 7, 13, "दो है।")] * 2)
    assert sentences(df.limit(0), "text", "id").count() == 0


def test_dandas_beyond_the_basic_plane():
    """Kaithi, Sharada, Modi, Newa and Brahmi."""
    for letter, danda in (("\U0001108d", "\U000110c0"), ("\U00011191", "\U000111c5"), ("\U0001160e", "\U00011641"), ("\U0001140e", "\U0001144b"), ("\U00011013", "\U00011047")):
        first = f"{letter * 3} {letter * 4}{danda}"
        assert spans(f"{first} {letter * 5}{danda}") == [(0, len(first)), (len(first) + 1, len(first) + 7)]
