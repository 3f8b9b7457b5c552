import time

import pytest

from graphloom.llm.sentences import abbreviation, sentence_spans, sentences

CASES = [
    ["Mr. Ann paid 4.50 marks.", "Dr. Bo left at 5 a.m.", "It rose."],
    ["At 2.30 p.m. the bell fell.", "Tallow, Fenn & Co. sold it to Prof. Cy, Jr.", "They spoke."],
    ["“We leave tonight. Bring it!” said Ann.", "“Never,” Bo said, “will it go.”", "The door, i.e. the old one, stood by No. 39."],
    ["The note read: “Not before 5 a.m. Wait for me.”", "(Ann had never asked.)", "'What? No!' cried Bo, and left.", '"Is it?" she said to Mrs. Cy.'],
    ["Ann waited… and the door stayed.", "J. K. Ossery, Esq. kept it, etc. in one drawer.", "See vol. 3, p. 9 of it."],
    ["« Attends ! Prends la loi », dit Ann.", "« Où est-il ? » demanda Bo.", "Vers 18 h. 30, la loi fut portée.", "M. Cy paya 2,72 francs."],
    ["—¡Espera! —dijo Ann, y tomó la sopa.", "—¡Espera! —dijo Bo.", "«¿Dónde está?», preguntó Cy.", "La Sra. Ann guardó el puente, etc. en Batazar.", "¡Qué lejos!", "¿Y tú?"],
    ["Am 3. Mai kam das Lied z. B. nach Batazar.", "„Warte! Ich komme mit“, rief Ann.", "Dr. Bo zahlte 88,70 Mark."],
    ["कुरवेश ने 28.81 रुपये में लिया।", "“पुल कहाँ है?” तिमरू ने पूछा।", "वह पुराना था!", "डॉ. नेमसा ने देखा।"],
    ["พ.ศ. 2467 เป็นปีที่มา", "“สะพานอยู่ไหน” เวลนาถาม", "ออร์คาจ่ายเงิน 16.69 บาทซื้อ"],
]
JOINED = [
    ["他写道：“水壶……还在榛林”，然后睡了。", "灰雁说：“别走！带上灯笼。”", "“钟在哪里？”杉渡问。", "谁还记得？"],
    ["苔丸は「待て。籠を持って来い！」と言った。", "「どこだ？」と灰雁丸は尋ねた。", "なんと古い窓だろう！"],
]


@pytest.mark.parametrize(("units", "gap"), [(c, " ") for c in CASES] + [(c, "") for c in JOINED] + [(CASES[0], "\n"), (CASES[2], "  ")])
def test_units(units, gap):
    text = gap.join(units)
    assert [text[a:b] for a, b in sentence_spans(text)] == units


@pytest.mark.parametrize(
    ("text", "units"),
    [
        (None, []), ("", []), (" \n\n ", []), ("no end", ["no end"]), (".", ["."]), ("Chapter 3\n\nHello there. Bye", ["Chapter 3", "Hello there.", "Bye"]),
        ("one\ntwo. Three\n \nfour", ["one\ntwo.", "Three", "four"]), ("“Open. Then\n\nNext. One", ["“Open.", "Then", "Next.", "One"]),
        ("leave tonight. Go!” said Ann. Bo left. “We go. Now", ["leave tonight. Go!” said Ann.", "Bo left.", "“We go. Now"]),
        ("带上石桥。”谁还记得？", ["带上石桥。”", "谁还记得？"]), ("水壶在哪里？”柏砚问。好。", ["水壶在哪里？”柏砚问。", "好。"]),
        ("More than that?Ann came.", ["More than that?", "Ann came."]), ("1. Cut it. 2. Fry it.", ["1. Cut it.", "2. Fry it."]),
        ("It failed on line 53. Ann left.", ["It failed on line 53.", "Ann left."]), ("I said no. Ann left me. Bo", ["I said no.", "Ann left me.", "Bo"]),
    ],
)
def test_edges(text, units):
    assert [text[a:b] for a, b in sentence_spans(text)] == units


def test_every_character_is_in_one_unit():
    text = "A (b. c) “d. e” f!? g… H. «i. J 'k. l 。m\n\nn ) o. P” q. " * 30
    spans = sentence_spans(text)
    inside = set()
    for a, b in spans:
        assert a < b and not text[a].isspace() and not text[b - 1].isspace()
        assert not inside & set(range(a, b))
        inside |= set(range(a, b))
    assert all(text[i].isspace() or i in inside for i in range(len(text)))


def test_abbreviations():
    assert abbreviation("Mr", 2) == "never" and abbreviation("xmr", 3) == "" and abbreviation("5 a.m", 5) == "may" and abbreviation("No", 2) == "numbered"


def test_very_long_text_and_table(spark):
    long = "Ann saw it. " * 20_000
    rows = [("a", "One. Two.", 1), ("a", "One. Two.", 2), (None, "Three.", 1), ("b", None, 1), ("c", "", 1), ("d", long, 1)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, char_start int")
    got = [tuple(r) for r in sentences(df).collect()]
    assert sorted(x for x in got if x[0] == "a") == [("a", 0, 4), ("a", 5, 9)] and (None, 0, 6) in got
    assert len([x for x in got if x[0] == "d"]) == 20_000 and len(got) == 20_003
    assert sentences(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "units",
    [
        ["Chapter Thirteen", "Ann left the house."], ["Chapter 3. The Bridge", "Ann left the house."], ["Chapter 3 - The Bridge", "“Go!” said Ann."],
        ["Ann left the house by the long bridge that night.", "THE LOWER ROAD", "Bo came."], ["Chapter Twenty-One – The Mill of Bo", "Ann left."],
        ["Ann left the house by the long bridge that night.", "The Lower Road", "Bo came to the mill and saw what it was."],
        ["Part of\nthe house fell."], ["Part One was over\nand Ann left."], ["When Ann\nLee left, Bo came."], ["He met\nAnn Lee and Bo at the old\nbridge."],
    ],
)
def test_headings_by_their_form(units):
    text = "\n".join(units)
    assert [text[a:b] for a, b in sentence_spans(text)] == units


@pytest.mark.parametrize("speech", ["“{}", "Ann said: “{}", "„{}", "「{}", "Ann cried, \"{}", "Bo said, '{}", "Bo said, 'It's not far. {}"])
def test_a_long_speech_that_the_edge_cuts_off_is_one_unit(speech):
    text = "It rose. " + speech.format("We leave tonight. Bring the lantern! " * 20 + "Now")
    assert [text[a:b] for a, b in sentence_spans(text)] == ["It rose.", text[9:]]


def test_marks_that_open_nothing_at_the_end():
    for text in ("“We go. “Now,” said Ann. Bo left.", "It was 5\" long. Ann left."):
        assert len(sentence_spans(text)) > 1


def test_list_levels():
    text = "1. Cut it.\n\n2. Fry it.\n\n2.1. Stir. 2.2. Turn. 3. Eat."
    assert [text[a:b] for a, b in sentence_spans(text)] == ["1. Cut it.", "2. Fry it.", "2.1. Stir.", "2.2. Turn.", "3. Eat."]
    text = "i. Cut it. ii. Fry it. iii. Eat. It was ii. Then."
    assert [text[a:b] for a, b in sentence_spans(text)] == ["i. Cut it.", "ii. Fry it.", "iii. Eat.", "It was ii.", "Then."]
    text = "1. Cut. a. Thin. b. Thick. 2. Fry. a. Hot. 4. Ann."
    assert [text[a:b] for a, b in sentence_spans(text)] == ["1. Cut.", "a. Thin.", "b. Thick.", "2. Fry.", "a. Hot.", "4.", "Ann."]


def test_marks_that_are_never_closed_cost_no_more_passes():
    text = "“word ( foo. " * 20_000
    began = time.process_time()
    spans = sentence_spans(text)
    assert time.process_time() - began < 20 and spans[-1][1] == len(text.rstrip())


@pytest.mark.parametrize("tail", ["Go on. (He never came. Bo left. " + "It rose again. " * 40 + "Now", "Go on. (He never came. Now"])
def test_an_open_bracket_is_judged_by_its_context(tail):
    assert [tail[a:b] for a, b in sentence_spans(tail)] == ["Go on.", tail[7:]]
