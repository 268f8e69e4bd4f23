"""The rules: which sentences a pattern counts in, and the patterns.

A rule is data; a user may pass rules of the same form from a JSON file.
"""

from __future__ import annotations

import json
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    id: str
    scope: str  # sentence, sentence_start, para_last, paragraph or all
    patterns: tuple[str, ...]
    max_len: int | None = None
    raw: bool = False  # before quotes are masked
    headings: bool = False
    tables: bool = False


# Scopes and patterns of the 54 rules.
RULES = (
    Rule("G2.experience", "sentence", (
        r"(직접|실제로)\s*(써|사용해|운영해|적용해|돌려|테스트해|도입해)\s*(보니|봤더니|보면서|본\s*결과)",
        r"(써|사용해|운영해|적용해)\s*보니(까)?\s",
    )),
    Rule("G3.chatbot", "sentence", (
        r"궁금한\s*(점|부분|사항)(이|은)?\s*(있|생기|남)",
        r"^물론(입니다|이죠|이에요|이지요)",
        r"요청(하신|해\s*주신)\s*(글|내용|대로|자료|사항)",
        r"원하시면",
        r"(더|추가로)\s*(필요하시면|궁금하시면)",
        r"(AI|인공지능|언어\s*모델)(로서|인\s*저는|인\s*제가)",
        r"제가\s*학습한",
    )),
    Rule("G3.placeholder", "sentence", (
        r"\[(링크|URL|이미지|그림|회사명|이름|출처|날짜|작성자)[^\]]{0,20}\]",
        r"(OOO|○○○|ㅇㅇㅇ)",
        r"\((이미지|그림)\s*(삽입|첨부)\)",
    )),
    Rule("G3.source_meta", "sentence", (
        r"(제공|첨부|공유|전달)(된|해\s*주신|하신|받은)\s*(자료|문서|글|파일|PDF)",
        r"주어진\s*(자료|문서|글)(에|을|를|의|에서)",
        r"원문(에\s*따르면|을\s*바탕으로)",
        r"해당\s*자료",
    )),
    Rule("G8.beyond_simple", "sentence", (
        r"단순(한|히)\s+[^.?!]{0,40}?(을|를)\s*넘어",
        r"단순한\s+[^.?!]{0,20}?그\s*이상",
    )),
    Rule("G9.cliche_intro", "sentence", (
        r"오늘날[^.?!]{0,40}(빠르게|급속(도로|히)|급격(하게|히))",
        r"(시대|시기)(가|이)\s*(도래|열리|열렸|왔)",
        r"점점\s*(더\s*)?(중요해지|주목받)",
        r"(빠르게|급속도로)\s*변화하는\s*(환경|시대|세상)",
    )),
    Rule("G9.cliche_outro", "sentence", (
        r"앞으로[^.?!]{0,25}(기대(됩니다|돼요|가\s*됩니다|해\s*봅니다)|주목(됩니다|돼요))",
        r"무궁무진",
        r"새로운\s*(지평|장|가능성)을\s*(열|여|제시)",
        r"(미래|앞날)(가|는|이)\s*(밝|기대)",
        r"귀추가\s*주목",
    )),
    Rule("G9.empty_challenge", "sentence", (
        r"^(물론\s*)?[^.?!]{0,8}(과제|숙제|한계)(도|는|가)\s*(여전히\s*|아직\s*)?(남아\s*있|분명(합|해|하)|존재(합|해))",
    ), max_len=35),
    Rule("A1.np_anira", "sentence", (
        r"(이|가|게)\s*아니라(?!고|면)",
    )),
    Rule("A1.np_rather", "sentence", (
        r"(라기|하기|이기)\s*보다(는)?\s",
    )),
    Rule("A1.np_geuchi", "sentence", (
        r"에\s*그치지\s*않",
    )),
    Rule("A1.np_neomeo", "sentence", (
        r"(^|\s)[^\s\d%]{1,20}(을|를)\s*넘어(서)?[\s,]",
    )),
    Rule("A1.np_deoisang", "sentence", (
        r"더\s*이상\s*[^.?!]{0,20}(이|가)\s*아닌",
    )),
    Rule("A1.np_simple", "sentence", (
        r"단순(히|한)\s+[^.?!]{0,30}?(이|가|게)\s*아니라",
    )),
    Rule("A1.ppunman", "sentence", (
        r"뿐(만)?\s*아니라",
    )),
    Rule("A3.salience", "sentence", (
        r"(가장\s*)?중요한\s*(것|점|건|부분)(은|이|는)",
        r"^핵심(은|이)\s",
        r"^(관건|요점)(은|이)\s",
        r"주목할\s*(만한\s*)?(점|것|부분|대목)",
        r"눈여겨\s*(볼|봐야\s*할)\s*(점|것|부분|대목)",
        r"(이|이것|이게|이\s*점|이는)\s*(이|은|는|가)?\s*(매우\s*|정말\s*|특히\s*|무엇보다\s*)?중요(합니다|해요|하다)",
        r"(것|게)이?\s*(매우\s*|무엇보다\s*|특히\s*|가장\s*)?중요(합니다|해요|하다)",
        r"왜\s[^.?!]{0,30}중요(할까요|한가|한지|할까)",
        r"(기억해야|기억해\s*둘|명심해야)\s*할?\s*(점|것)",
        r"무엇보다(도)?\s*(중요|핵심)",
        r"(점이|것이|부분이|대목이|결과는|결과가)\s*[^.?!]{0,15}?(흥미롭|인상적|놀랍|극적)",
        r"(흥미로운|인상적인|놀라운|주목할\s*만한)\s*(점|것|부분|대목|결과)(은|는|이|가)",
        r"(진짜|진정한)\s*(강점|가치|의미|핵심)(은|는|이|가)",
    )),
    Rule("A4.summary_start", "para_last", (
        r"^(결국|요컨대|한마디로|정리하면|정리하자면|즉|이처럼|이렇듯|다시\s*말해|요약하면)(\s|,)",
    )),
    Rule("A4.obligation_end", "para_last", (
        r"(해야|돼야|되어야|봐야|가져야|챙겨야|고려해야|확인해야|살펴봐야)\s*(합니다|해요|한다|할\s*것입니다|할\s*거예요)[.?!]?$",
    )),
    Rule("A4.lesson_end", "para_last", (
        r"(보여\s*줍니다|보여\s*줘요|보여준다|일깨워\s*줍니다|일깨워\s*줘요|시사합니다|시사해요|말해\s*줍니다|말해\s*줘요|방증합니다)[.?!]?$",
        r"(라는|다는)\s*(점|사실)을\s*(보여|기억|잊지)",
    )),
    Rule("A4.gyeolguk", "sentence", (
        r"(^|\s)결국(\s|,)",
    )),
    Rule("A5.style_words", "sentence", (
        r"시사(하|합|해|한|할|점|하는\s*바)",
        r"구조적(인|으로)?",
        r"체계적(인|으로)?",
        r"통합적(인|으로)?",
        r"다층적(인|으로)?",
        r"핵심적(인|으로)?",
        r"실질적(인|으로)?",
        r"전략적(인|으로)?",
        r"혁신적(인|으로)?",
        r"획기적(인|으로)?",
        r"원활(하|한|히|합|해)",
        r"기능(합니다|해요|한다|하는|하며|하고|할|했)",
        r"규명(하|합|해|한|했|할)",
        r"메커니즘",
        r"기제",
    )),
    Rule("A5.policy_verbs", "sentence", (
        r"(강화|확대|개선|확보|마련|구축)(하|합|해|한|할|했|되|됩|돼|된|될)",
    )),
    Rule("A6.calque", "sentence", (
        r"떠받(치|쳐|친|칠)",
        r"(^|\s)조용히\s",
        r"(두|세|네|다섯|여러|몇)\s*(개의\s*)?(축|갈래)(으로|로|이|가|을|를|에서|입니다|예요|이에요|가\s*있)",
        r"(봐야|챙겨야|살펴야|고민해야|들어가야)\s*(하는|할)\s*자리",
        r"여정",
        r"지평",
        r"청사진",
        r"발판",
        r"토대(를|가|로|이|가\s*되)",
        r"초석",
        r"신호탄",
        r"퍼즐\s*조각",
        r"양날의\s*검",
        r"게임\s*체인저",
        r"판도를\s*(바꾸|뒤집)",
        r"빙산의\s*일각",
        r"나침반",
        r"주춧돌",
        r"날개를\s*(달|단)",
        r"민낯",
        r"(숨은|숨겨진)\s*(영웅|공신|주역)",
        r"마법(처럼|같은|과\s*같)",
    )),
    Rule("A7.hedge_stack", "sentence", (
        r"(할|될|있을|일)\s*수\s*(도\s*)?있을\s*(것|듯)",
        r"가능성이\s*있을\s*수",
        r"(것|듯)\s*(으로|처럼)?\s*보일\s*수",
        r"(일|할)\s*수도\s*있을\s*것",
    )),
    Rule("A7.read_as", "sentence", (
        r"(으로|로)\s*읽(힙니다|혀요|힌다|힐\s*수|을\s*수\s*있)",
        r"(것을|점을|다고|라고)\s*읽을\s*수\s*있",
    )),
    Rule("A7.see_as", "sentence", (
        r"(다고|라고)\s*볼\s*수\s*있",
    )),
    Rule("A7.must_may", "sentence", (
        r"[가-힣]야\s*(할|될)\s*수\s*(도\s*)?있",
    )),
    Rule("A7.hedge_boimnida", "sentence", (
        r"(것|듯)으로\s*(보입니다|보여요|보인다|판단됩니다|예상됩니다|추정됩니다)",
    )),
    Rule("A12.progressive", "sentence", (
        r"(되|지|해지|어지|아지|워지)고\s*있(습니다|어요|다|는|으며|고|었)",
    )),
    Rule("A13.demonstrative_start", "sentence_start", (
        r"^(이는|이를\s*통해|이를\s*위해|이러한|이런\s*점에서|이처럼|이렇듯|이에\s*따라|이와\s*같이)(\s|,)",
    )),
    Rule("A14.translationese", "sentence", (
        r"그것(은|이|을|의|에)(\s|$)",
        r"(에|에게)\s*의(해|하여|한)(\s|$)",
        r"가장\s*[가-힣A-Za-z]+(한|인|된|는)\s*[가-힣A-Za-z ]{1,15}\s*중\s*(의\s*)?하나",
        r"중요한\s*역할을\s*(하|합|해|한|담당|수행)",
        r"(을|를)\s*가지고\s*있(습니다|어요|다|는|으며)",
    )),
    Rule("A14.doeeojida", "sentence", (
        r"되어(?:지|진|질|집|져|졌)",
        r"(?<![가-힣])(?:보여|쓰여|씌여|잊혀|짜여|불려|나뉘어|믿겨|열려|닫혀|읽혀|놓여|담겨|바뀌어|쌓여|섞여|묶여)(?:지|진|질|집|져|졌)",
    )),
    Rule("A14.causative", "sentence", (
        r"(?<![가-힣])(?:소개|연결|포함|유지|통합|전환|적용|입력|반영|교육|주입|접목|결합|대입)\s?시(?:키|켜|켰|킨|킬|킵|킴)",
    )),
    Rule("A5.pleonasm", "sentence", (
        r"(?<![가-힣])약\s?(?:\d[\d.,]*|한|두|세|네|다섯|여섯|일곱|여덟|아홉|열|수십|수백|수천|몇)\s?[^\s.?!,]{0,6}\s?(?:정도|가량|쯤)(?:의|로|이|가|를|은|는|에|까지|만)?(?![가-힣])",
        r"(?<![가-힣])약\s?\d[\d,]*\s?여\s?[가-힣]",
        r"(?<![가-힣])다시\s+재(?:개|시작|확인|설정|발|구성|실행|시도|배포|사용|생성|연결|부팅|검토|전송|처리|계산|학습)",
        r"과반수\s?(?:이상|넘게|를\s?넘)|가장\s+최(?:선|고|적)|먼저\s+선행|새로(?:이|게)?\s+신설|서로\s+상충|함께\s+공존|미리\s+(?:예약|예측|예상|예고)",
    )),
    Rule("A14.adverb_pair", "sentence", (
        r"(?<![가-힣])결코\s(?!.*(?:않|없|못|아니|아닌|아닙|말|모르|모릅|몰라|안\s))",
        r"(?<![가-힣])비록\s(?!.*(?:지만|더라도|어도|아도|여도|해도|라도|으나|이나|는데|은데|인데|지언정|망정))",
        r"(?<![가-힣])왜냐(?:하)?면\s(?!.*(?:때문|므로|니까|거든|[아어여해]서(?![가-힣])|라서))",
        r"(?<![가-힣])만약(?:에)?\s(?!.*(?:면|경우|때|거든|더라도|해도|라도))",
    )),
    Rule("G11.spelling", "all", (
        r"되요(?![가-힣])|됬|(?<![가-힣])되서(?:는|도|야)?(?![가-힣])|(?<![가-힣])되도(?!록)(?![가-힣])",
        r"몇\s?일(?=$|[\s.,?!)]|(?:이|을|은|의|에|이나|도|만|부터|까지|째|간|동안|씩|만에)(?![가-힣]))",
        r"(?<![가-힣])금새(?![가-힣])|어떻해|왠만|웬지|왠일|뵈요|가르키|역활|오랫만|일일히|깨끗히|틈틈히|곰곰히|희안|어의없",
        r"[할볼줄갈올릴을]께(?:요)?(?![가-힣])",
    ), headings=True, tables=True),
    Rule("A21.jeokda_as", "sentence", (
        r"(?:을|를)\s+(?:\S+\s+){0,2}?\S+(?:으로|로)\s+(?:적습니다|적어요|적는다|적었|적고|적으며|적을|적겠|적기로)",
    )),
    Rule("INFO.we", "sentence", (
        r"저희\s*(팀|회사|조직)?(은|는|이|가|도|의)",
    )),
    Rule("INFO.closing_wish", "sentence", (
        r"도움이\s*(되셨|되었|됐|되었으|되길|되기를)(기를|길|으면|으리라|기\s*바랍)?",
    )),
    Rule("A4.summary_opener", "sentence_start", (
        r"^(결론적으로|요약하자면|요약하면|종합하면|종합하자면|종합해\s*보면)",
    )),
    Rule("A16.source_subject", "sentence_start", (
        r"^(저자들?|연구진|연구팀|논문|이 논문|원문|노트|이 노트|이 문서|문서)(은|는|이|가|에 따르면|의)\s",
    )),
    Rule("A18.number_predicate", "paragraph", (
        r"[\d.,]+\s*(?:배|%p|%|개|건|명|토큰|칸|ms|초|분|시간|GB|MB|TB|KB|점|회|번|차례|자)?\s*(?:입니다|이었습니다|였습니다|이에요|예요|이었어요|였어요)[.?!]?\s*$",
    ), max_len=45),
    Rule("A18.generic_predicate", "paragraph", (
        r"(?:경우|결과|방법|방식|몫|셈)(?:입니다|이었습니다|였습니다|이에요|예요|이었어요|였어요)[.?!]?\s*$",
    ), max_len=45),
    Rule("A18.bare_reference", "paragraph", (
        r"^(?:둘|셋|차이|그 차이|이 차이|이 값|그 값|이 수치|그 수치|그 크기|이 크기|그 결과|이 결과)(?:은|는|을|를|이|가|도|와|과)?\s",
    )),
    Rule("A18.paren_clause", "paragraph", (
        r"\([^()]{0,60}[가-힣A-Za-z0-9|]+(?:은|는)\s[^(),]{1,30},[^()]{1,40}\)",
        r"\([^()]{2,60}[가-힣](?:다|고|며|면|서|지만|는데|므로)\)",
        r"\((?!예[:를 ])[^()]{0,30}[가-힣]{2,}[^(),]{0,20},\s?[^()]{0,30}[가-힣]{2,}[^()]{0,30}\)",
    )),
    Rule("A18.bundle", "paragraph", (
        r"[가-힣]{1,10}[·/][가-힣]{1,10}",
    )),
    Rule("A18.negation_scope", "sentence", (
        r"모든\s[^\s.?!,]+(?:\s[^\s.?!,]+)?(?:이|가)\s(?:(?!거나|때까지|하나도|어느|아무|지만|면서|는데|든지|더라도|다고|라고|는지|을지)[^.?!,]){0,25}?지\s*(?:않|못)(?:았|었|했|습|아요|어요|는다|한다|다)",
        r"(?:가|이|은|는)\s모두\s(?:(?!거나|때까지|하나도|어느|아무|지만|면서|는데|든지|더라도|다고|라고|는지|을지)[^.?!,]){0,20}?지\s*(?:않|못)(?:았|었|했|습|아요|어요|는다|한다|다)",
    )),
    Rule("A6.window_range", "all", (
        r"(?:시간|적분|관찰|분석|측정|기록|통합|반응|자극|학습|탐지|검출|노출|예측|관측|컨텍스트|문맥|슬라이딩|집계|고정|이동|롤링|세션)\s?창(?=$|[\s.,:;)\]|]|(?:은|는|이|가|을|를|의|에|에서|에서는|에는|과|와|도|만|으로|로|으로는|로는|이며|이고|이나|처럼|보다|까지|부터|마다)(?![가-힣]))",
        r"\d\s?(?:ms|초|분|시간|일|주|개월|년)\s?창(?=$|[\s.,:;)\]|]|(?:은|는|이|가|을|를|의|에|에서|에서는|에는|과|와|도|만|으로|로|으로는|로는|이며|이고|이나|처럼|보다|까지|부터|마다)(?![가-힣]))",
    ), headings=True, tables=True),
    Rule("A6.calque_check", "all", (
        r"(?:변화|효과|영향|차이|반응|정보|기능|자극)(?:가|이|는|은|도)\s*(?:크게\s*|여전히\s*|그대로\s*|아직\s*)?남(?:아|았|는|을|은)",
        r"손으로\s*(?:다시\s*|직접\s*)?(?:계산|셌|세어|세면|센|구해|구했|구한|풀)",
    )),
    Rule("A14.quoted_english_token", "all", (
        r'''["“'‘][A-Za-z][A-Za-z.'’\-]*(?:\s[A-Za-z.'’\-]+)?["”'’]\s*(?:로|으로|라고|이라고|를|을|이|가|는|은)\s*(?:쓴|썼|씁|써|적은|적었|적어|살린|살려|표현|옮긴|옮겼|추정|단정|한정)''',
    ), raw=True),
    Rule("A14.quoted_english_check", "all", (
        r'''["“'‘][A-Za-z][A-Za-z.'’\-]*(?:\s[A-Za-z.'’\-]+)?["”'’]\s*(?:로|으로)\s*(?:끝나|끝난|끝납|보이|보일|보인|보여)''',
    ), raw=True),
    Rule("A14.report_write", "all", (
        r'''(?:다|라|⟦Q⟧|["”’'])고(?:도|는)?\s+(?:\S+(?:에서는|에서|에는|에도|에)\s+)?(?:씁니다|써요|쓴다|썼|쓰고\s|쓰며\s|적습니다|적어요|적는다|적었|적고\s|적으며\s)''',
    )),
    Rule("A14.report_write_check", "all", (
        r'''(?:다|라|⟦Q⟧|["”’'])고(?:도|는)?\s+(?:\S+(?:에서는|에서|에는|에도|에)\s+)?(?:쓴\s|적은\s)''',
    )),
    Rule("A5.archaic_words", "all", (
        r"(?<![가-힣])옛\s",
        r"수치적으로\s*(?:거의\s*|사실상\s*)?(?:0|같|동일|무시)",
        r"제시(?:된|되었|됐)",
        r"(?:전술|후술)(?:한|할|하는|된)",
        r"에\s?기인(?:한|하|합|해|했)",
        r"무비판적",
    )),
)


def load(path: str) -> tuple[Rule, ...]:
    """Rules from a JSON file: {"patterns": {id: {"scope", "regex", "max_len", "raw", "headings", "tables"}}}."""
    with open(path, encoding="utf-8-sig") as f:
        found = json.load(f)["patterns"]
    return tuple(Rule(k, r.get("scope", "sentence"), tuple(r["regex"]), r.get("max_len"), bool(r.get("raw")), bool(r.get("headings")), bool(r.get("tables"))) for k, r in found.items())


def by_id(rules: tuple[Rule, ...]) -> dict[str, Rule]:
    return {r.id: r for r in rules}
