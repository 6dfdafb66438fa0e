"""Published word pairs of the English stemming rules."""

import pytest

from remedy.functions.stem import english_stem

PAIRS = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist
consistency consist consistent consist consistently consist consisting consist consists consist consolation consol
consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid
consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson
consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci
conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl
constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack
knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel
kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight
knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob
knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
caresses caress ponies poni ties tie cries cri gas gas this this gaps gap kiwis kiwi agreed agre feed feed plastered plaster
motoring motor sing sing hopping hop hoping hope conflated conflat luxuriating luxuri falling fall happy happi say say
by by enjoy enjoy generate generat generously generous communication communic arsenal arsenal skies sky dying die
news news inning inning exceed exceed succeed succeed national nation relational relat digitizer digit operator oper
feudalism feudal hopefulness hope analogy analog apology apolog electrical electr goodness good adoption adopt
homologous homolog effective effect bowdlerize bowdler rate rate cease ceas controlling control roll roll
yellow yellow youth youth sayings say cy cy see see beds bed
""".split()


def test_published_pairs(spark):
    from pyspark.sql import functions as F
    rows = list(zip(PAIRS[::2], PAIRS[1::2]))
    got = spark.createDataFrame(rows, "w string, s string").select("w", "s", english_stem(F.col("w")).alias("g")).collect()
    assert [(r.w, r.g) for r in got if r.s != r.g] == []


@pytest.mark.parametrize("word", ["", "a", "über", "été", "日本", "2024", "x1s", "naïvement", "yyyy", "y"])
def test_any_term_has_a_stem(spark, word):
    from pyspark.sql import functions as F
    got = spark.createDataFrame([(word,)], "w string").select(english_stem(F.col("w")).alias("g")).first().g
    assert got is not None and len(got) <= len(word)
