"""Korean sentence endings and counts as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings and word lists.
TRAILING = " \t.?!…\"'”’)]}」』:;~*_,"
NOUNS_IN_YO = "필요 중요 주요 수요 개요 강요 소요 요요".split()
NOUNS_IN_DA = "람다 판다 바다 어젠다 아젠다".split()
NOMINAL = "(함|됨|했음|됐음|였음|었음|았음|있음|없음|같음|좋음|않음)$"
NOT_NOMINAL = "결함 포함".split()
BANNED = "더라고요 더군요 네요 잖아요 답니다".split()
EXPERIENCE = "더라고요 더군요 네요".split()
POLITE_BUCKETS = (
    ("더라고요", "C_DEORAGO"), ("더군요", "C_DEORAGO"), ("잖아요", "C_JANAYO"), ("네요", "C_NEYO"), ("거든요", "C_GEUDEUN"),
    ("는데요", "C_NEUNDEYO"), ("은데요", "C_NEUNDEYO"), ("인데요", "C_NEUNDEYO"), ("고요", "C_GOYO"), ("게요", "C_WILL"),
    ("세요", "C_SEYO"), ("나요", "C_Q"), ("가요", "C_Q"), ("죠", "C_JYO"), ("지요", "C_JYO"),
)
CONNECTIVES = "면서도 으면서 면서 지만 는데 은데 인데 던데 으며 며 니까 므로 도록 더라도 다가 거나 든지 려고 다면 라면 으면 면 고서 고 서".split()
NOUNS_IN_GO = "참고 최고 보고 경고 광고 사고 재고 창고 원고 신고 라고 다고 자고 냐고 제고 등고".split()
NOUNS_IN_MYEON = "측면 반면 화면 표면 전면 단면 국면 방면 장면 정면 평면 이면 내면 지면 대면 직면 수면 후면 앞면 뒷면 한편".split()
VOWELS_BEFORE_SEO = (0, 1, 4, 6, 9, 10, 14)
SENTENCE_ADVERBS = "그리고 그러나 그런데 그러므로 하지만 그래서 따라서 그러니까 또한 반면 즉 특히 다만 예를 결과적으로 한편 게다가 물론 아울러 덧붙여".split()
CONJUNCTIONS = "그리고 그러나 그런데 그러므로 하지만 그래서 따라서".split()
PARTICLES = "에서는 에서 으로 보다 까지 부터 처럼 에는 은 는 이 가 을 를 의 와 과 에 로".split()
EDGE = "\"'“”‘’()[]{}<>.,?!:;…·「」『』"

PLACEHOLDER = "⟦[CURQ]⟧"
FIRST_SYLLABLE, SYLLABLES, FINALS, VOWELS = 0xAC00, 11172, 28, 21
FINAL_B, FINAL_SS = 17, 20


def ends(word: Column, suffixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (word.endswith(s) for s in suffixes))


def _syllable(ch: Column, value) -> Column:
    code = F.ascii(ch) - FIRST_SYLLABLE
    return F.when((code >= 0) & (code < SYLLABLES), value(code)).otherwise(-1)


def final(ch: Column) -> Column:
    """The number of a syllable's final consonant, 0 if it has none, -1 if it is no syllable."""
    return _syllable(ch, lambda c: F.pmod(c, F.lit(FINALS)))


def vowel(ch: Column) -> Column:
    return _syllable(ch, lambda c: F.pmod(F.floor(c / FINALS).cast("int"), F.lit(VOWELS)))


def initial(ch: Column) -> Column:
    return _syllable(ch, lambda c: F.floor(c / (FINALS * VOWELS)).cast("int"))


def at(word: Column, place: int) -> Column:
    """The character at a negative place from the end; empty if the word is shorter."""
    return F.when(F.length(word) >= -place, F.substring(word, place, 1)).otherwise("")


def strip_end(s: Column) -> Column:
    return F.rtrim(s, F.lit(TRAILING))


def strip_end_marks(token: Column) -> Column:
    """A token without commas and then closing marks at its end."""
    return F.rtrim(F.rtrim(token, F.lit(",，")), F.lit("\"'”’)]}」』"))


def last_word(s: Column) -> Column:
    """The last word, without placeholders, up to three closing parentheses and marks at the end."""
    s = F.trim(F.regexp_replace(s, PLACEHOLDER, " "))
    for _ in range(3):
        s = F.regexp_replace(s, r"(?U)\s*[(\[][^()\[\]]*[)\]]\s*[.?!…]*\s*$", "")
    return F.regexp_extract(strip_end(s), r"(?U)(\S+)$", 1)


def ending_class(word: Column, question: Column) -> Column:
    """HAPNIDA, HAEYO, Q_KKAYO, HAERA, NOMINAL, NOUN or OTHER; the first case that holds."""
    third_b = final(at(word, -3)) == FINAL_B
    return (
        F.when(~word.rlike("[가-힣]$"), "OTHER")
        .when(ends(word, ["니다", "니까"]) & third_b, "HAPNIDA")
        .when(word.endswith("십시오") | (word.endswith("시다") & third_b), "HAPNIDA")
        .when(ends(word, ["요", "죠"]) & ends(word, NOUNS_IN_YO), "NOUN")
        .when(word.endswith("까요"), "Q_KKAYO")
        .when(ends(word, ["요", "죠"]), "HAEYO")
        .when(word.endswith("다") & ~ends(word, NOUNS_IN_DA), "HAERA")
        .when(question & ends(word, ["까", "냐", "니", "가", "나"]), "HAERA")
        .when(word.rlike(NOMINAL) & ~ends(word, NOT_NOMINAL), "NOMINAL")
        .otherwise("NOUN")
    )


def ending_bucket(sentence: Column, word: Column, cls: Column) -> Column:
    tail = strip_end(F.regexp_replace(sentence, PLACEHOLDER, " "))
    past = lambda ch: (final(ch) == FINAL_SS) & ~ch.isin("있", "겠")
    formal = (
        F.when(word.endswith("니까"), "D_Q")
        .when(ends(word, ["십시오", "시다"]), "D_IMP")
        .when(tail.rlike(r"(?U)수\s*있습니다$"), "D_CAN")
        .when(word.endswith("겠습니다"), "D_FUT")
        .when(ends(word, ["있습니다", "없습니다"]), "D_EXIST")
        .when(word.endswith("것입니다"), "D_GEOT")
        .when(word.endswith("입니다"), "D_COP")
        .when(word.endswith("습니다") & past(at(word, -4)), "D_PAST")
        .when(word.endswith("습니다"), "D_S_PRES")
        .otherwise("D_B_PRES")
    )
    polite = reduce(lambda c, x: c.when(word.endswith(x[0]), x[1]), POLITE_BUCKETS[1:], F.when(word.endswith(POLITE_BUCKETS[0][0]), POLITE_BUCKETS[0][1]))
    polite = (
        polite.when(tail.rlike(r"(?U)수\s*있어요$"), "C_CAN")
        .when(ends(word, ["있어요", "없어요"]), "C_EXIST")
        .when(ends(word, ["거예요", "거에요"]), "C_GEO")
        .when(ends(word, ["예요", "에요"]), "C_COP")
        .when(ends(word, ["어요", "아요"]) & past(at(word, -3)), "C_PAST")
        .otherwise("C_PRES")
    )
    return F.when(cls == "HAPNIDA", formal).when(cls == "HAEYO", polite).otherwise(cls)


def is_connective(word: Column) -> Column:
    """Whether a word ends in a connective; the first suffix of the list that fits decides."""
    before = at(word, -2)
    seo = ~ends(word, ["에서", "께서"]) & (final(before) == 0) & vowel(before).isin(*VOWELS_BEFORE_SEO)
    rest = {"고": ~ends(word, NOUNS_IN_GO), "면": ~ends(word, NOUNS_IN_MYEON), "서": seo}
    case = reduce(lambda c, s: c.when(word.endswith(s), rest.get(s, F.lit(True))), CONNECTIVES[1:], F.when(word.endswith(CONNECTIVES[0]), F.lit(True)))
    return (F.length(word) >= 2) & case.otherwise(F.lit(False))


def ungrouped(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)(?<=\d),(?=\d{3})", "")


def comma_count(masked: Column) -> Column:
    return F.regexp_count(ungrouped(masked), F.lit("[,，]"))


def words(s: Column) -> Column:
    return F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")


def is_triad(masked: Column) -> Column:
    """Three or more comma parts, the inner ones of 1 to 4 words and free of digits, Latin letters and placeholders."""
    parts = F.transform(F.split(ungrouped(masked), "[,，]"), lambda p: F.trim(p))
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    data = "[0-9A-Za-z⟦]"
    head = F.regexp_extract(parts[0], r"(?U)(\S+)\s*$", 1)
    short = F.forall(inner, lambda p: ~p.rlike(data) & F.size(words(p)).between(1, 4))
    return (F.size(parts) >= 3) & short & ~head.rlike(data)


def tokens(masked: Column) -> Column:
    """Words without marks at their edges."""
    cut = F.transform(words(F.regexp_replace(masked, PLACEHOLDER, " ")), lambda w: F.trim(w, F.lit(EDGE)))
    return F.filter(cut, lambda w: w != "")


def strip_particle(word: Column) -> Column:
    """The word without the longest particle that leaves two characters."""
    longest = sorted(PARTICLES, key=len, reverse=True)
    return F.regexp_replace(word, "^(.{2,}?)(?:" + "|".join(longest) + ")$", "$1")


def visible_chars(s: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_replace(s, PLACEHOLDER, ""), r"(?U)\s", ""))


def number_keys(s: Column, *, drop_bare_digits: bool) -> Column:
    """Normal forms of the numbers in a text, in order: no grouping, no zeros at either end of the digits."""
    units = "%p|%|배|x|×|ms|초|분|시간|개|건|명|만|억|천|조|GB|MB|KB|TB|토큰|단어|문장|편|회|번|자|어절|쌍|년|점"
    form = r"(?U)(?<![\w.\-])(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:\s*(?:" + units + r"))?"
    found = F.regexp_extract_all(F.regexp_replace(s, PLACEHOLDER, " "), F.lit(form), F.lit(0))

    def key(m: Column) -> Column:
        whole = F.regexp_replace(F.regexp_extract(m, r"(?U)^([\d,]+)", 1), ",", "")
        part = F.rtrim(F.regexp_extract(m, r"(?U)^[\d,]+\.(\d+)", 1), F.lit("0"))
        plain = F.concat(whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))
        unit = F.trim(F.regexp_replace(m, r"(?U)^[\d,]+(?:\.\d+)?", ""))
        short = F.ltrim(plain, F.lit("0"))
        return F.struct(F.when(short == "", "0").otherwise(short).alias("key"), ((F.length(plain) == 1) & (unit == "")).alias("bare"))

    keys = F.transform(found, key)
    if drop_bare_digits:
        keys = F.filter(keys, lambda k: ~k["bare"])
    return F.transform(keys, lambda k: k["key"])


def holdout(doc_id: Column) -> Column:
    """Whether the SHA-1 of the id is divisible by 5: 16 is 1 modulo 5, so its digits' sum decides."""
    digits = F.split(F.sha1(doc_id.cast("string").cast("binary")), "")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0), lambda a, d: a + F.conv(d, 16, 10).cast("int")) % 5 == 0
