"""Word lists and patterns of the minutes domain.

Fixed values: they must be what the corpus's clerks and speakers write, so results depend on them word by word.
"""

MARKERS = "◯◎"
HEADINGS = "【■□▶▷◆◇"
NOISE = {
    "meeting_header": r"^\s*\d*\s*제\d+회.{0,60}\)\s*\d*\s*$",
    "session_no": r"^제\d+회\s*국회\s+제\s*\d+\s*호\s*$",
    "committee_title": r"^[가-힣]{4,25}(위원회|소위원회)(회의록)?$",
    "session_type": r"^\s*\([임정][시기]회\)\s*$",
    "page_number": r"^\s*\d{1,4}\s*$",
    "divider": r"^[\s─━\-=／*]{5,}$",
}
PAGE_MARK = r"^[\s\-―–]+\d{1,4}[\s\-―–]+$"
REPORT_START = r"^【[^】]{0,20}】|^[■□▶▷◆◇]\s*(보고사항|처리된\s*의안|감사결과|위원\s*선임|간사\s*선임|수석전문위원)"
AGENDA_START = r"^의\s*사\s*일\s*정|^상\s*정\s*된\s*안\s*건|^\d+\.\s*(보고|심사|제정|개정|동의|승인|의결|청문|질의)\b"
SENTENCE_LAST = "다요죠까냐네며서고면"
PARTICLE_LAST = "가이을를은는의에도만"
FORCED_JOIN = r"^(겠|습니|니다|ㅂ니|십니|었|았|셨)"

PARTICLES = ["에서의", "으로써", "으로서", "에서", "에게", "께서", "부터", "까지", "처럼", "보다", "하고", "이나", "이란", "라는", "으로", "과의", "와의", "에는", "에도", "은", "는", "이", "가", "을", "를", "의", "에", "로", "와", "과", "도", "만", "요"]

#: What a question says of itself, and words that stand in any speech.
STOPWORDS = [
    "대한", "대해", "대해서", "관련", "관련해", "관련된", "어떤", "어떻게", "무엇", "무슨", "어느", "언제", "누가", "누구", "왜", "및", "또는", "그리고", "등",
    "있나", "있나요", "인가요", "한가요", "했나요", "됐나요", "주세요", "알려주세요", "말해줘", "무엇인가요", "어떠했나요", "밝혔나요", "보였나요", "취했나요",
    "발언", "입장", "논의", "언급", "질의", "질문", "답변", "주장", "요약", "정리", "내용", "여부", "구체적", "구체적인", "주요", "관한", "위원회에서", "회의에서",
]
#: Marks that are taken off both ends of a question's words.
EDGE_MARKS = ".,?!·'\"“”‘’()[]"

COMPARE = r"여야|입장\s*차이|정당\s*간|찬반|비교"
TIMELINE = r"경과|추이|흐름|연혁|변해\s*왔|바뀌어\s*왔|어떻게\s*진행"
ACTOR = r"(정부|대통령실|[가-힣]{2,4}\s*(?:장관|차관|처장|청장|위원장|의원|후보자))[은는이가의]?\s*[^,.\n]{0,10}?(입장|생각|견해|반응|태도|주장|답변)"
#: A day or a month in a question, with and without its year.
DATE_FULL, DATE_ISO, DATE_MONTH = r"(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일", r"(\d{4})-(\d{2})-(\d{2})", r"(\d{4})\s*년\s*(\d{1,2})\s*월(?!\s*\d)"
DATE_DAY_ONLY, DATE_MONTH_ONLY = r"(\d{1,2})\s*월\s*(\d{1,2})\s*일", r"(\d{1,2})\s*월(?!\s*\d)"
SPEECH_MARK, AROUND, GROUP_HEADING = "발언", "주변 맥락", "━━ %s 근거 ━━"
SESSION_HEADER = r"제\d+회[-–—]?.{0,50}\d+차\s*\(\d{4}년\d+월\d+일\)"
LIMITS_HEADING, LIMITS_SECTION = "## 논의의 한계", r"(?s)##\s*논의의 한계.*?(?=\n##\s|\z)"
DANGLING_TAIL, PARTY_DISCLAIMER = r"(?:이\s?외의?|이\s?부분은)[^.\n]*확인할 수 없습니다\.?", r"[^.\n]*소속 정당[^.\n]*확인할 수 없습니다\.?"
PARTY_QUESTION = r"여야|정당|진영|소속"
CHUNK_TYPES = ["utterance", "qa_pair"]
QUESTION = r"[?？]|질의|질문|여쭤|물어|어떻게\s*생각|않습니까\??|않나요|인가요\??|하십니까\??"
MOTION = ["찬성", "반대", "의결", "동의합니다", "가결", "부결", "표결"]
POSITIVE = ["찬성", "동의", "지지", "환영", "긍정적", "바람직", "적극"]
NEGATIVE = ["반대", "우려", "문제", "비판", "부정적", "심각", "부적절", "잘못"]

ASSEMBLY_ROLES = ["위원", "위원장", "소위원장", "위원장대리", "간사", "의원", "조정위원장"]
STAFF_ROLES = ["전문위원", "수석전문위원", "입법조사관", "행정실장", "사무처장", "사무총장"]
WITNESS_ROLES = ["증인", "참고인", "진술인"]
NOMINEE = r"후보자?$"
EXECUTIVE = r"장관|차관|청장|처장|차장|총장|국무위원|대통령|비서관|대변인|협력관|정부위원|위원장$"
NOT_NAMES = ["어떤", "여러", "각", "해당", "본", "다음", "이", "그", "저"]
CHAIR_ROLES = ["위원장", "소위원장", "위원회위원장"]
LAST_ROLES = ["위원", "의원", "장관", "차관", "청장", "원장", "부장", "과장", "전문위원", "수석전문위원", "입법조사관", "국장", "실장", "본부장", "처장", "대표", "사장", "간사"]
#: Endings of titles that stand before a name ("…장관 이름"); the ending of two syllables and 관 stands for all such offices.
FIRST_ROLE_ENDINGS = [
    "위원장", "부위원장", "장관", "차관", "청장", "차장", "처장", "원장", "실장", "국장", "과장", "계장", "본부장", "부장", "소장", "총장", "총재", "의장", "단장", "대장",
    "사장", "은행장", "회장", "관장", "팀장", "센터장", "서장", "사령관", "정책관", "조정관", "심의관", "기획관", "관리관", "담당관", "협력관", "조사관", "검사관", "감사관",
    "교육관", "정보관", "분석관", "기술관", "행정관", "[가-힣]{2}관", "후보자", "대표이사", "대표", "이사장", "이사", "감사", "위원장대리", "직무대리", "직무대행", "권한대행", "대리", "대행", "위원", "간사",
]
FIRST_ROLES = ["증인", "참고인", "진술인", "공술인", "전문위원", "수석전문위원", "위원장대리", "입법조사관"]
#: A name of Hangul or Han characters, or one made anonymous.
NAME = r"[가-힣]{2,7}|[一-鿿豈-﫿]{2,5}|[가-힣]{1,3}[0-9○]{2}"
#: (pattern, group of the name, group of the role) of a speaker's header; the first match wins.
SPEAKER_FORMS = [
    (r"^([가-힣]{2,10}(?:부|처|청|원|실|국)(?:장관|차관|청장|원장|실장|국장))\s+([가-힣]{2,5})$", 2, 1),
    (rf"^({'|'.join(CHAIR_ROLES)})\s+([가-힣]{{2,5}})$", 2, 1),
    (rf"^([가-힣0-9A-Za-z㈜()·&]{{1,30}}(?:{'|'.join(FIRST_ROLE_ENDINGS)})|{'|'.join(FIRST_ROLES)})\s+({NAME})$", 2, 1),
    (rf"^([가-힣]{{2,5}}|[一-鿿豈-﫿]{{2,5}})\s+({'|'.join(LAST_ROLES)})$", 1, 2),
    (r"^([가-힣]{2,5})$", 1, 0),
]
DROPPED_HEADERS = r"^(출석|정부측|기타\s*참석자?|위원\s*선임|의안\s*회부|예비심사기간|청원\s*회부|계획서\s*송부|보고서\s*송부|행정입법\s*제출|수석전문위원\s*명단|전문위원\s*(?:명단|현황)|처리된\s*의안|보고사항|부록|출장\s*위원|위원\s*아닌\s*출석|소위원회\s*직접\s*회부|청가\s*위원|청가\s*의원)"
DROPPED_NAMES = ["출석", "정부측", "기타", "참석자", "행정입법", "계획서", "보고서", "예비심사기간", "청원", "보고사항", "부록", "의안", "출장", "위원", "소위원회", "청가"]
RULING = [("2024-05-30", "2025-06-03", "국민의힘"), ("2025-06-04", "9999-12-31", "더불어민주당")]
SATELLITES = {"국민의미래": "국민의힘", "더불어민주연합": "더불어민주당"}
REFUSAL_STRICT = r"확인(할 수 없|되지 않|이 되지 않)"
REFUSAL_BROAD = r"확인(할 수 없|되지 않|이 되지 않)|포함(되어|하고) 있지 않|언급(이|은|도)? ?(없|되지 않)|찾을 수 없|나와 ?있지 않"
BILLS = [r"[가-힣A-Za-z0-9]+법\s*(?:개정안|제정안|일부개정안|전부개정안)", r"[가-힣A-Za-z0-9]+\s*(?:기본법|특별법|특례법|촉진법|지원법|보호법)", r"제\d+조(?:의\d+)?"]
STANCES = ["support", "oppose", "concern", "neutral", "none"]
#: What an actor's stances add up to.
STANCE_LABELS = ["support", "oppose", "concern", "mixed", "no_stance"]
#: Rows of a composition that aren't parties; they come last, in this order.
GOVERNMENT_ROW, NO_PARTY_ROW, NO_PARTY = "정부측", "무소속/미상", "무소속"
RULING_SIDE, OPPOSING_SIDE = "여당", "야당"
