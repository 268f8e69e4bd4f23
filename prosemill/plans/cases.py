"""Own sentences and articles with known results."""

#: sentence, last word, class, bucket
ENDINGS = [
    ("서버가 요청을 처리합니다.", "처리합니다", "HAPNIDA", "D_B_PRES"),
    ("캐시를 쓰면 속도를 높일 수 있습니다.", "있습니다", "HAPNIDA", "D_CAN"),
    ("설정 파일이 두 개 있습니다.", "있습니다", "HAPNIDA", "D_EXIST"),
    ("다음 절에서 설명하겠습니다.", "설명하겠습니다", "HAPNIDA", "D_FUT"),
    ("이 값은 기본값입니다.", "기본값입니다", "HAPNIDA", "D_COP"),
    ("오류가 사라질 것입니다.", "것입니다", "HAPNIDA", "D_GEOT"),
    ("지난주에 버전을 올렸습니다.", "올렸습니다", "HAPNIDA", "D_PAST"),
    ("메모리가 적습니다.", "적습니다", "HAPNIDA", "D_S_PRES"),
    ("왜 느릴 것이라고 봅니까?", "봅니까", "HAPNIDA", "D_Q"),
    ("먼저 문서를 읽으십시오.", "읽으십시오", "HAPNIDA", "D_IMP"),
    ("같이 살펴봅시다.", "살펴봅시다", "HAPNIDA", "D_IMP"),
    ("서버가 요청을 처리해요.", "처리해요", "HAEYO", "C_PRES"),
    ("지난주에 버전을 올렸어요.", "올렸어요", "HAEYO", "C_PAST"),
    ("바로 확인할 수 있어요.", "있어요", "HAEYO", "C_CAN"),
    ("파일이 하나 있어요.", "있어요", "HAEYO", "C_EXIST"),
    ("이게 기본값이에요.", "기본값이에요", "HAEYO", "C_COP"),
    ("곧 끝날 거예요.", "거예요", "HAEYO", "C_GEO"),
    ("생각보다 빠르더라고요.", "빠르더라고요", "HAEYO", "C_DEORAGO"),
    ("값이 다르네요.", "다르네요", "HAEYO", "C_NEYO"),
    ("캐시가 비어 있거든요.", "있거든요", "HAEYO", "C_GEUDEUN"),
    ("값을 바꿨는데요.", "바꿨는데요", "HAEYO", "C_NEUNDEYO"),
    ("그렇죠.", "그렇죠", "HAEYO", "C_JYO"),
    ("제가 해 볼게요.", "볼게요", "HAEYO", "C_WILL"),
    ("문서를 보세요.", "보세요", "HAEYO", "C_SEYO"),
    ("왜 느릴까요?", "느릴까요", "Q_KKAYO", "Q_KKAYO"),
    ("서버가 요청을 처리한다(그림 1).", "처리한다", "HAERA", "HAERA"),
    ("왜 느린가?", "느린가", "HAERA", "HAERA"),
    ("설정을 바꾸지 않음.", "않음", "NOMINAL", "NOMINAL"),
    ("버전 정보 포함", "포함", "NOUN", "NOUN"),
    ("설명이 더 필요", "필요", "NOUN", "NOUN"),
    ("문서 개요", "개요", "NOUN", "NOUN"),
    ("자바의 람다", "람다", "NOUN", "NOUN"),
    ("See the manual.", "manual", "OTHER", "OTHER"),
    ("값은 ⟦C⟧", "값은", "NOUN", "NOUN"),
]

#: word, whether it ends in a connective
CONNECTIVES = [
    ("빠르지만", True), ("읽으면서", True), ("측면", False), ("화면", False), ("하면", True), ("보고", False), ("쓰고", True),
    ("창고", False), ("에서", False), ("가서", True), ("해서", True), ("문서", False), ("하므로", True), ("인데", True), ("모델", False),
    ("면", False), ("use", False), ("", False),
]

#: Sentences in which rules find something, or nothing.
RULE_SENTENCES = [
    "실제로 써 보니 생각보다 빨랐습니다.",
    "궁금한 점이 있으면 알려 주세요.",
    "물론입니다, 정리해 드리겠습니다.",
    "제공된 자료에 따르면 값이 다릅니다.",
    "단순한 저장소를 넘어 플랫폼이 됩니다.",
    "오늘날 기술은 빠르게 바뀝니다.",
    "앞으로 어떻게 바뀔지 기대됩니다.",
    "무궁무진한 쓰임이 있습니다.",
    "빠르기보다는 정확하게 만들었습니다.",
    "빠르다기보다 정확합니다.",
    "속도에 그치지 않고 정확도까지 봅니다.",
    "한계를 넘어서 성장합니다.",
    "속도뿐만 아니라 정확도도 봅니다.",
    "가장 중요한 것은 순서입니다.",
    "핵심은 순서입니다.",
    "결국 순서가 문제였습니다.",
    "이 구조적인 문제를 시사합니다.",
    "캐시 메커니즘이 기능합니다.",
    "성능 개선했고 도구를 강화합니다.",
    "이 작업은 긴 여정의 발판입니다.",
    "마법처럼 빨라집니다.",
    "할 수도 있을 것입니다.",
    "이 결과는 실패로 읽힙니다.",
    "성공했다고 볼 수 있습니다.",
    "다시 해야 할 수도 있습니다.",
    "느린 것으로 보입니다.",
    "처리되고 있습니다.",
    "이를 통해 알 수 있습니다.",
    "규칙에 의해 정해집니다.",
    "가장 빠른 도구 중 하나입니다.",
    "저희 팀은 이 도구를 씁니다.",
    "이 글이 도움이 되셨으면 합니다.",
    "결론적으로 값이 같습니다.",
    "저자들은 값이 같다고 말합니다.",
    "처리량은 30배입니다.",
    "이 값은 3입니다.",
    "이런 경우입니다.",
    "그 차이는 큽니다.",
    "읽기/쓰기가 느립니다.",
    "값을 손으로 계산했습니다.",
    "수치적으로 같습니다.",
    "전술한 방법을 씁니다.",
    "서버가 요청을 처리합니다.",
    "The server answers requests.",
    "",
]

ARTICLES = (
    ("plain", "# 캐시\n\n서버가 요청을 받습니다. 서버가 값을 읽습니다.\n\n값이 없으면 디스크를 봅니다.\n"),
    (
        "marked",
        "# 속도가 아니라 순서다\n\n속도가 중요하지만, 순서가 먼저입니다. 빠르고, 가볍고, 단단한 도구를 썼습니다.\n\n"
        "## 결과: 값\n\n- **하나**: 값을 읽습니다\n- 둘\n- 셋\n\n결국, 값을 바꿨습니다. 값을 바꿨습니다. 그리고, 끝났습니다 — 정말로.\n\n## 참고 자료\n\n- A; B, 1–5쪽\n",
    ),
    ("polite", "값을 읽어요. 값을 써요. 왜 그럴까요? 비어 있거든요.\n"),
    ("empty", ""),
)

#: Counted by hand.
ARTICLE_VALUES = [
    ("plain", "A8.sentences_per_para", 1.5),
    ("plain", "A8.single_para_ratio", 0.5),
    ("plain", "A9.list_ratio", 0.0),
    ("plain", "A2.comma_per_sentence", 0.0),
    ("plain", "A8.ending_run4", 0.0),
    ("plain", "G4.off_tone", 0.0),
    ("marked", "A1.np_title", 1.0),
    ("marked", "A2.connective_comma_ratio", 1.0),
    ("marked", "A4.gyeolguk", 1.0),
    ("marked", "A8.same_predicate_adjacent", 1.0),
    ("marked", "A9.label_list_ratio", 0.25),
    ("marked", "A9.heading_colon_ratio", 0.5),
    ("marked", "G6.emdash", 1.0),
    ("marked", "G6.punct_policy", 1.0),
    ("marked", "G6.semicolon", 0.0),
    ("marked", "G7.conj_comma", 1.0),
    ("polite", "T.kkayo_ratio", 0.25),
    ("polite", "T.geudeun_ratio", 0.25),
    ("polite", "A11.body_questions", 1.0),
    ("polite", "G4.off_tone", 0.0),
    ("empty", "A8.sent_len_mean", 0.0),
    ("empty", "G6.emoji", 0.0),
]

_FORMAL = "# 제목\n\n서버가 값을 읽습니다. 값은 3개입니다.\n\n- 항목 이름\n"
_POLITE = "# 제목\n\n서버가 값을 읽어요. 값은 3개예요.\n\n- 항목 이름\n"
TONE_PAIRS = (
    ("valid", _FORMAL, _POLITE),
    ("token", _FORMAL, _POLITE.replace("3", "4")),
    ("count", _FORMAL, _POLITE.replace(" 값은 3개예요.", "")),
    ("prefix", _FORMAL, _POLITE.replace("서버가 값을 읽어요", "기계가 값을 읽어요")),
    ("frozen", _FORMAL, _POLITE.replace("제목", "이름")),
    ("structure", _FORMAL, _POLITE.replace("# 제목\n\n", "")),
    ("tone", _FORMAL, _POLITE.replace("읽어요", "읽습니다")),
    ("banned", _FORMAL, _POLITE.replace("읽어요", "읽네요")),
    ("cause", _FORMAL, _POLITE.replace("읽어요", "읽거든요")),
    ("stem", _FORMAL, _POLITE.replace("읽어요", "봐요")),
    ("polarity", _FORMAL, _POLITE.replace("값을 읽어요", "값을 못 읽어요")),
    ("dtone", _FORMAL.replace("읽습니다", "읽어요"), _POLITE),
)
TONE_CODES = [
    ("token", "TOKEN", 1),
    ("token", "STEM", 1),
    ("count", "SENT_COUNT", 1),
    ("prefix", "PREFIX", 1),
    ("frozen", "FROZEN", 1),
    ("structure", "STRUCTURE", 1),
    ("tone", "C_TONE", 1),
    ("banned", "BANNED", 1),
    ("cause", "GEUDEUN", 1),
    ("stem", "STEM", 1),
    ("polarity", "POLARITY", 1),
    ("polarity", "STEM", 1),
    ("dtone", "D_TONE", 1),
]

_SOURCE = "# Title\n\n- one `x = 1` at https://a.example/b\n- two 3,000 <@U1> Keep\n\n```\ncode\n```\n"
_TARGET = "# 제목\n\n- 하나 `x = 1` https://a.example/b\n- 둘 3,000 <@U1> 유지\n\n```\ncode\n```\n"
TERMS = (("Keep", "유지"), ("blocked", "차단"))
FIDELITY_PAIRS = (
    ("faithful", _SOURCE, _TARGET),
    ("block", _SOURCE, _TARGET.replace("code\n", "kode\n")),
    ("span", _SOURCE, _TARGET.replace("x = 1", "x = 2")),
    ("url", _SOURCE, _TARGET.replace("/b", "/c")),
    ("token", _SOURCE, _TARGET.replace("<@U1> ", "")),
    ("number", _SOURCE, _TARGET.replace("3,000", "3000")),
    ("heading", _SOURCE, _TARGET + "\n## 더\n"),
    ("item", _SOURCE, _TARGET + "\n- 셋\n- 넷\n"),
    ("term", _SOURCE + "Blocked\n", _TARGET.replace("유지", "보관")),
)
FIDELITY_VALUES = [
    ("block", "F1.code_blocks", 1),
    ("span", "F2.inline_code", 1),
    ("url", "F3.urls", 1),
    ("token", "F4.slack_tokens", 1),
    ("number", "F5.numbers", 1),
    ("heading", "F7.headings", 1),
    ("item", "F6.list_items", 2),
    ("term", "F8.terms", 2),
]

REPEAT_ARTICLES = (
    ("baseline", "무작위 추측 정확도 20%보다 높게 나왔습니다. 무작위 추측 정확도 20%보다 낮게 끝났어요.\n"),
    ("change", "처리량이 30% 늘었습니다.\n\n이전 버전보다 지연 시간이 30% 줄었습니다.\n"),
    ("subject", "모델은 작은 편입니다만 값이 정확하게 나오는 편에 속합니다. 모델은 빠르게 돌아가고 메모리를 적게 쓰는 쪽에 들어갑니다. 모델은 학습을 다시 시키지 않아도 계속 쓸 만합니다.\n"),
    ("frame", "서버가 먼저 값을 읽습니다. 이름을 씁니다.\n\n서버가 다시 줄을 읽습니다. 순서를 바꿉니다.\n\n서버가 끝내 글을 읽습니다.\n"),
    ("word", "값을 읽어요.\n\n이름을 읽어요.\n\n줄을 읽어요.\n"),
    ("neighbours", "값을 읽어요. 다시 읽어요.\n"),
    ("many", "모델은 작습니다. 모델은 빠릅니다. 모델은 정확합니다.\n\n# 절\n\n짧습니다. 모델은 가볍습니다. 아주 짧아요. 정말 짧아요.\n"),
    ("clean", "서버가 값을 읽습니다.\n"),
)
REPEATS = [
    ("frame", "R4", "서버가 … 읽습니다", 3),
    ("frame", "R5", "0", 5),
    ("word", "R4", "읽어요", 3),
    ("neighbours", "R7", "읽어요", 1),
    ("many", "R3", "모델은", 3),
    ("many", "R5", "1", 4),
    ("many", "R7", "짧아요", 1),
    ("baseline", "R1", "추측 정확도 20%", 2),
    ("change", "R6", "start", 1),
    ("subject", "R3", "모델은", 3),
]

# Texts and the values of their metrics, counted by hand.  A text stands for one rule or measure: what counts, and
# beside it what looks like it and doesn't.
MEASURED = (
    ("placeholders", "자세한 내용은 [링크]에 있습니다. 회사는 ○○○입니다. 여기에 (그림 첨부)가 들어갑니다. 서버가 답합니다.", {"G3.placeholder": 3}),
    ("challenges", "한계도 여전히 남아 있습니다. 숙제는 남아 있습니다만 그 숙제를 지금 바로 풀어야 할 까닭은 어디에도 없습니다.", {"G9.empty_challenge": 1}),
    ("not this", "문제는 값이 아니라 순서입니다. 값이 아니라고 합니다. 값이 아니라면 됩니다.", {"A1.np_anira": 1, "A1.np": 1}),
    ("rather", "도구라기보다 방법입니다. 빨리 하기보다는 바르게 합니다. 이것보다 큽니다.", {"A1.np_rather": 2}),
    ("no longer", "더 이상 문제가 아닌 값입니다. 더 이상 없습니다.", {"A1.np_deoisang": 1}),
    ("simple", "단순한 도구가 아니라 방법입니다. 단순한 도구입니다.", {"A1.np_simple": 1, "A1.np_anira": 1}),
    ("obligation", "먼저 값을 봅니다. 다음을 확인해야 합니다.\n\n순서를 고려해야 합니다. 그 뒤에 끝납니다.\n\n- 확인해야 합니다.\n", {"A4.obligation_end": 1}),
    ("double passive", "값이 처리되어집니다. 글이 쓰여집니다. 값이 보입니다.", {"A14.doeeojida": 2}),
    ("causative", "서버를 연결시킵니다. 값을 적용시켰습니다. 서버를 연결합니다. 재연결시킵니다.", {"A14.causative": 2}),
    ("pleonasm", "약 30개 정도의 값이 있습니다. 다시 재시작합니다. 가장 최선입니다. 약 30개의 값이 있습니다.", {"A5.pleonasm": 3}),
    ("adverbs", "결코 빠릅니다. 결코 빠르지 않습니다. 만약 값이 큽니다. 만약 값이 크면 줄입니다. 비록 작지만 빠릅니다.", {"A14.adverb_pair": 2}),
    ("spelling", "# 되요\n\n| 되요 | b |\n|---|---|\n\n값이 됬습니다. 금새 끝납니다. “되요”라고 합니다. `되요` 하고 칩니다.\n\n```\n되요\n```\n\n## 참고 자료\n\n- 되요\n", {"G11.spelling": 4}),
    ("written as", "값을 정수로 적습니다. 이름을 적습니다.", {"A21.jeokda_as": 1}),
    ("parentheses", "값(처음에는 작고)은 늘어납니다. 값(처음)은 늘어납니다.", {"A18.paren_clause": 1}),
    ("scope of not", "모든 값이 맞지 않습니다. 값이 모두 맞지 않습니다. 모든 값이 맞습니다.", {"A18.negation_scope": 2}),
    ("windows", "## 슬라이딩 창\n\n관측 창을 넓힙니다. 10분 창이 끝납니다. 창문을 엽니다.", {"A6.window_range": 3}),
    ("quoted words", "논문은 \"attention\"을 씁니다. \"attention\"이 있습니다. 이름은 \"cache\"로 끝납니다.", {"A14.quoted_english_token": 1, "A14.quoted_english_check": 1}),
    ("reports", "논문은 값이 같다고 씁니다. 원문에 쉽다고 적었습니다. 논문은 값이 같다고 말합니다. 저자가 쉽다고 쓴 부분입니다.", {"A14.report_write": 2, "A14.report_write_check": 1}),
    ("archaic", "옛 방식입니다. 수치적으로 같습니다. 제시된 값입니다. 새 방식입니다.", {"A5.archaic_words": 3}),
    ("summary", "첫 문장입니다. 결국, 값이 같습니다.\n\n- 결국, 목록\n", {"A4.summary_start": 1, "A4.gyeolguk": 1, "A4.para_end": 1}),
    ("ends", "값을 봅니다. 결국 값이 같습니다.\n\n이 값은 차이를 보여 줍니다.", {"A4.para_end": 2, "A4.lesson_end": 1}),
    ("dashes", "본문 — 하나.\n\n`코드 — 둘`과 $a — b$와 https://x.y/—\n\n```\n셋 — 넷\n```\n\n# 제목 — 다섯\n\n| 표 — 여섯 | b |\n|---|---|\n\n> 인용 — 일곱\n\n## 참고 자료\n\n- 책 — 여덟, 1–5쪽\n", {"G6.emdash": 4, "G6.punct_policy": 1}),
    ("signs", "# 속도 ⭐\n\n값이 큽니다 🚀.\n\n값이 큽니다; 작지 않습니다.\n\n- 하나; 둘\n\n## 참고 자료\n\n- A; B\n", {"G6.emoji": 2, "G6.semicolon": 2}),
    ("contrasts", "문제는 속도가 아닙니다. 순서입니다. 값이 아니라 순서입니다.\n\n다음 글입니다.", {"A1.np": 2, "A1.np_first_para": 2, "A1.np_same_para": 1}),
    ("titles", "# 속도가 아니라 순서\n\n값입니다.", {"A1.np_title": 1, "A1.np": 0}),
    ("lengths", "값을 봅니다. 큰 값을 다시 봅니다.", {"A8.sent_len_mean": 9.5, "A8.sent_len_cv": 0.263, "A8.long_ratio": 0, "A8.same_predicate_adjacent": 1, "A8.ending_top_share": 1, "A8.sentences_per_para": 2}),
    ("long", "값을 " * 30 + "봅니다. 값을 봅니다.", {"A8.long_ratio": 0.5}),
    ("predicates", "값을 읽어요. 다시 읽어요. 또 읽어요?", {"A8.same_predicate_adjacent": 1, "A11.body_questions": 1}),
    ("runs", "가를 씁니다. 나를 씁니다.\n\n다를 씁니다. 라를 씁니다. 마를 씁니다.", {"A8.ending_run4": 1, "A8.single_para_ratio": 0}),
    ("paragraphs", "값을 봅니다.\n\n값을 봅니다. 값을 셉니다.\n\n값을 봅니다.", {"A8.single_para_ratio": 0.667, "A8.sentences_per_para": 1.33}),
    ("commas", "값, 이름, 순서를 봅니다. 1,000개를 봅니다.", {"A2.comma_per_sentence": 1, "A2.comma_sentence_ratio": 0.5, "A10.triad_per_1k": 43.48}),
    ("triads", "값, 이름, 순서를 봅니다. 하나, 둘, 셋을 셉니다.\n\n- 하나\n- 둘\n- 셋\n", {"A10.triad_same_para": 1}),
    ("links", "값이 크지만, 순서가 먼저입니다. 값이 작으면 줄입니다.", {"A2.connective_comma_ratio": 0.5}),
    ("openers", "서버가 값을 읽습니다. 서버가 값을 씁니다. 서버가 이름을 읽습니다.", {"A17.opener_repeat": 2}),
    ("sources", "저자들은 값이 같다고 합니다. 값이 큽니다.", {"A16.source_subject": 1, "A16.source_subject_share": 0.5}),
    ("bold", "**값**을 봅니다.", {"A9.bold_per_1k": 166.67}),
    ("lists", "값을 봅니다.\n\n- 이름을 봅니다.\n", {"A9.list_ratio": 0.538}),
    ("labels", "- 이름: 값을 봅니다.\n- **줄**: 값을 봅니다.\n- 값을 봅니다.\n- 줄을 봅니다.\n", {"A9.label_list_ratio": 0.5, "A9.list_ratio": 1}),
    ("headings", "## 왜 그럴까?\n\n## 값: 하나\n\n값을 봅니다.", {"A9.heading_per_1k": 333.33, "A11.question_heading_ratio": 0.5, "A9.heading_colon_ratio": 0.5}),
    ("style", "구조적인 값입니다. 구조적으로 봅니다. 시사합니다.", {"A5.style_words": 3, "A5.word_max": 2}),
    ("conjunctions", "그리고, 끝났습니다. 또한, 값이 큽니다. 서버가, 답합니다.", {"G7.conj_comma": 1, "INFO.adverb_comma": 1}),
    ("experience", "값이 크더라고요. 값이 다르네요. 값을 봐요.", {"G2.exp_ending": 2, "G4.banned_ending": 2, "G4.off_tone": 0}),
    ("mixed tone", "값을 읽어요. 값을 써요. 값이 다르네요. 값을 씁니다.", {"G4.off_tone": 1, "G4.banned_ending": 1}),
    ("tied tone", "값을 읽어요. 값을 씁니다.", {"G4.off_tone": 1, "G4.banned_ending": 0}),
    ("polite endings", "그렇죠. 값을 바꿨는데요. 값을 봐요. 비어 있거든요. 왜 그럴까요?", {"T.jyo_ratio": 0.2, "T.neundeyo_ratio": 0.2, "T.geudeun_ratio": 0.2, "T.kkayo_ratio": 0.2}),
)

#: A fact sheet and texts with the values of the metrics of terms, sources and verbs.
SHEET = """# 사실

| 원어 | 글에 쓸 표기 | 근거 | 쓰지 않을 표기 | 처음 나올 때 설명 |
|---|---|---|---|---|
| cache | 캐시 | 자료 | 은닉처, store | 자주 쓰는 값을 두는 곳 |
| queue / stack | 큐 / 스택 | 사전 | - | 일반 지식: 12개까지 담는다 |
| node | 노드 | 자료 | 없음 | 설명하지 않음 |

처리량은 1,500건이다.
"""
_CITES = "Marder (2020)는 값을 쟀습니다. Kim (2021)은 다르게 봤습니다. "
_CELLS = "수평 세포, 양극 세포, amacrine 세포가 있습니다. "
TERMED = (
    ("particles", "값이 3를 넘습니다. 값이 3을 넘습니다. 6로 갑니다. Llama 3은 큽니다. 수식 $3를$ 안은 보지 않습니다.", None, {"G10.num_particle": 2}),
    ("verbs", "이 방법을 씁니다. 글을 씁니다. 오류를 고칩니다. 하나를 고릅니다. 고른 분포를 보입니다. 널리 쓰입니다. 메모리에 값을 씁니다.", None, {"A5.native_verbs": 4}),
    ("judgements", "실패라고 봅니다. 이 값을 오류로 봅니다. 영역을 주로 봅니다. 값을 그래프로 봅니다.", None, {"A7.see_judgment": 2}),
    ("two spellings", "망막(retina)을 봅니다. 망막은 얇습니다. retina 층이 있습니다.", None, {"A19.term_mix": 1}),
    ("one spelling", "망막(retina)을 봅니다. 망막은 얇습니다.", None, {"A19.term_mix": 0}),
    ("acronym", "다중 버전(MVCC)을 봅니다. 다중 버전은 MVCC 입니다.", None, {"A19.term_mix": 0}),
    ("facts", "은닉처를 봅니다. 캐시는 빠릅니다. 큐를 씁니다. 처리량은 1500건이고 12개와 99개가 남습니다. worker 하나와 worker 둘, cache 셋과 cache 넷.", SHEET, {"A19.term_avoid": 1, "A20.term_first": 2, "A20.table_combined_row": 1, "A20.untabled": 1, "A15.unknown_numbers": 2}),
    ("in a list", _CELLS + "그 층은 얇습니다. 뒤에서는 amacrine 세포가 빛을 받습니다.", None, {"A20.term_in_list": 1}),
    ("list and next", _CELLS + "뒤에서는 amacrine 세포가 빛을 받습니다.", None, {"A20.term_in_list": 0}),
    ("abbreviation", "STG는 작습니다. STG를 봅니다. STG가 있습니다.", None, {"A20.abbr_first": 1}),
    ("explained", "STG(신경절)는 작습니다. STG를 봅니다. STG가 있습니다.", None, {"A20.abbr_first": 0}),
    ("known", "USB는 작습니다. USB를 봅니다. USB가 있습니다.", None, {"A20.abbr_first": 0}),
    ("species", "C. elegans는 작습니다. C. elegans를 봅니다. *Cancer borealis*는 큽니다.", None, {"A20.species_first": 2}),
    ("authors", _CITES + "\n\n# 절\n\n저자들은 값이 같다고 합니다.", None, {"A18.bare_author": 1}),
    ("named authors", _CITES + "저자들은 값이 같다고 합니다.", None, {"A18.bare_author": 0}),
    ("two senses", "이 방법을 씁니다. 논문은 값이 같다고 씁니다.", None, {"A21.sseuda_senses": 1}),
)

#: Texts cut into blocks: type, text, line, level, list and depth of each.
BLOCKS = (
    ("heading", "# 하나\n둘\n", (("heading", "하나", 1, 1, None, 0), ("paragraph", "둘", 2, 0, None, 0))),
    ("underlined", "제목\n===\n본문\n---\n", (("heading", "제목", 1, 1, None, 0), ("heading", "본문", 3, 2, None, 0))),
    ("front matter", "---\nkey: v\n---\n본문", (("paragraph", "본문", 4, 0, None, 0),)),
    ("fence", "```py\n# 아님\n```\n뒤", (("code", "# 아님", 1, 0, None, 0), ("paragraph", "뒤", 4, 0, None, 0))),
    ("open fence", "~~~\n열림", (("code", "열림", 1, 0, None, 0),)),
    ("list", "- a\n  이어짐\n- b\n\n  들여쓴 문단\n\n끝", (("list_item", "a 이어짐", 1, 0, 1, 0), ("list_item", "b", 3, 0, 1, 0), ("list_item", "들여쓴 문단", 5, 0, 1, 1), ("paragraph", "끝", 7, 0, None, 0))),
    ("depth", "- a\n  - b\n    - c\n- d\n\n글\n\n1. e\n", (("list_item", "a", 1, 0, 1, 0), ("list_item", "b", 2, 0, 1, 2), ("list_item", "c", 3, 0, 1, 3), ("list_item", "d", 4, 0, 1, 0), ("paragraph", "글", 6, 0, None, 0), ("list_item", "e", 8, 0, 2, 0))),
    ("quote", "> 인용\n이어짐\n\n> 다음", (("blockquote", "인용 이어짐", 1, 0, None, 0), ("blockquote", "다음", 4, 0, None, 0))),
    ("html", "<!-- x\ny -->\n<div>\nz\n</div>\n\n본문", (("html", "", 1, 0, None, 0), ("html", "", 3, 0, None, 0), ("paragraph", "본문", 7, 0, None, 0))),
    ("indented", "본문\n***\n    code", (("paragraph", "본문", 1, 0, None, 0), ("code", "    code", 3, 0, None, 0))),
)

#: Texts and their sentences.
SENTENCES = (
    ("versions", "버전 3.5입니다. 다음은 4.0입니다.", ("버전 3.5입니다.", "다음은 4.0입니다.")),
    ("abbreviation", "예를 들면(e.g. 이것) 됩니다. 끝.", ("예를 들면(e.g. 이것) 됩니다.", "끝.")),
    ("initial", "J. Smith가 썼다. 읽었다.", ("J. Smith가 썼다.", "읽었다.")),
    ("quoted", '"왜? 몰라." 하고 말했다. 갔다.', ('"왜? 몰라." 하고 말했다.', "갔다.")),
    ("marks", "정말?! 그래… 좋아.", ("정말?!", "그래…", "좋아.")),
    ("no stop", "끝이 없다", ("끝이 없다",)),
    ("too long", "가" * 300 + " (나. 다" + "라" * 200 + ". 마", ("가" * 300 + " (나.", "다" + "라" * 200 + ".", "마")),
)

#: Inline forms: the text without them, and with quotes masked.
INLINES = (
    ("forms", "**굵게** `a.b` ![그림](x.png) [이름](http://x.y/(z)) [a][b] <https://q.w> https://e.r/t 주[^1] 근거[1, 2–3] <b>t</b> *강조* \\*별", "굵게 ⟦C⟧ 이름 a ⟦U⟧ ⟦U⟧ 주 근거⟦R⟧ t 강조 *별", "굵게 ⟦C⟧ 이름 a ⟦U⟧ ⟦U⟧ 주 근거⟦R⟧ t 강조 *별", 1),
    ("quotes", "그는 “말”과 '한글'과 'abc'를 \"q\" 「책」", "그는 “말”과 '한글'과 'abc'를 \"q\" 「책」", "그는 ⟦Q⟧과 ⟦Q⟧과 'abc'를 ⟦Q⟧ ⟦Q⟧", 0),
    ("backticks", "``a`b`` 끝", "⟦C⟧ 끝", "⟦C⟧ 끝", 0),
    ("address", "https://a.b/c)d 끝", "⟦U⟧)d 끝", "⟦U⟧)d 끝", 0),
)

#: Web pages and their Markdown.
PAGES = (
    ("all", "<header>no</header><h1>A <b>b</b></h1><p>one <strong>two</strong><br>three <code>x</code></p><ul><li>l1<ol><li>l2</li></ol></li></ul><blockquote><p>q</p></blockquote><pre>a\n  b</pre><table><tr><th>h</th><th>i</th></tr><tr><td>1|2</td></tr></table><script>var x = '<p>';</script><p></p>", "# A b\n\none **two** three `x`\n\n- l1\n\n  1. l2\n\n> q\n\n```\na\n  b\n```\n\n| h | i |\n|---|---|\n| 1/2 |  |\n"),
    ("tail", "<p>본문입니다.다음</p><p>홍길동님의 다른 글</p><p>뒤</p>", "본문입니다. 다음\n"),
    ("nested", "<div><h2>제목</h2><section><p>하나</p></section></div><nav><p>없음</p></nav><h3>셋</h3>", "## 제목\n\n하나\n\n### 셋\n"),
    ("plain", "글 &amp; 값", "글 & 값\n"),
    ("empty", "", "\n"),
)
