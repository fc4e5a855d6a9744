"""Patterns and word lists that decide results, as data. Every pattern is compiled for Unicode classes, as U() says."""

from __future__ import annotations


def U(pattern: str, flags: str = "") -> str:
    """A Java pattern with Unicode-aware classes and bounds, and other inline flags."""
    return f"(?U{flags}){pattern}"


# ---- Fixed values: they have to be as they are for the results to be right. ----

# Cleaning.
MAX_CHARS, MIN_CHARS, FLAT_CHARS = 40_000, 200, 300
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
#: What \\s stands for with Unicode classes.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = "[ \\t\\u00a0\\u3000]+"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]+"
PHONE = r"\b0\d{1,2}[-.)]\s?\d{3,4}[-.]\d{4}\b"
MOBILE = r"\b01[016-9][-.]?\d{3,4}[-.]?\d{4}\b"
RESIDENT = r"\b\d{6}[-\s]?[1-4]\d{6}\b"
MASK_EMAIL, MASK_PHONE, SCRUBBED = "[이메일]", "[연락처]", "[삭제]"
BOARD_LINE = r"^\s*(?:이전\s?글|다음\s?글|목록(?:으로)?|글쓰기|수정|삭제|인쇄|스크랩|공유(?:하기)?|좋아요|댓글\s?\d*|조회\s?수?\s?\d*|추천\s?\d*|첨부\s?파일|파일\s?다운로드|맨\s?위로|top|prev|next|list|share|print)\s*$"
BOARD_META = r"^\s*(?:작성자|작성일|등록일|조회\s?수|게시일|첨부)\s*[:：]?\s*\S.*(?:조회\s?수|등록일|작성일|게시일)\s*[:：]?\s*[\d.\-\s]+\s*$"
TRAILER = r"\n?\s*대학생\s*대외활동\s*공모전\s*채용\s*사이트.*$|\n?\s*https?://linkareer\.com/?\s*$"
INJECTION = (
    r"(?:위|이전|앞|모든|상기)\s?(?:의\s?)?(?:지시|명령|규칙|내용)(?:을|를|은|는)?\s?(?:모두\s?)?무시"
    r"|\[\s?(?:시스템|system)\s?(?:안내|메시지|프롬프트|지시)?\s?\]"
    r"|system\s?prompt|ignore\s+(?:all\s+|the\s+)?(?:previous|above|prior)\s+instructions"
    r"|(?:이|본)\s?문단(?:은|을)\s?출력하지|(?:으로|로)\s?(?:만\s?)?출력(?:한다|하라|할\s?것)"
)
LABEL_HEADS = (
    "모집", "지원", "접수", "신청", "제출", "선발", "활동", "우대", "자격", "혜택", "문의", "시상", "심사", "전형", "채용", "근무", "급여", "지역", "학력", "경력", "마감", "시작", "결과", "발표",
    "기간", "대상", "인원", "방법", "내용", "서류", "일정", "절차", "요건", "조건", "사항", "개요", "주제", "주최", "주관", "후원",
)
SECTION_HEADS = r"우대\s?(?:사항|조건|요건)|자격\s?요건|(?:지원|응시|신청|참가)\s?자격|전형\s?(?:절차|방법|일정)|제출\s?서류|접수\s?방법|(?:유의|기타)\s?사항|문의처"
BULLET_SIGNS = "▶■□●○◆◇▪※☞➤►✅✔📌📅📆🎬🙌💬📥"
LIST_SYLLABLES = "가나다라마바사아자차카타파하"
_NO_HEAD = "".join(f"(?<!{h})" for h in LABEL_HEADS)
#: Where a flat text gets its line breaks back: before signs, list numbers, labels and section heads.
SEGMENT_BEFORE = (
    rf"\s*(?=[{BULLET_SIGNS}]|[①-⑳]|\[[^\]]{{1,12}}\])"
    rf"|\s+(?=(?:\d{{1,2}}|[{LIST_SYLLABLES}]|[ⅠⅡⅢⅣⅤ]|[IVX]{{1,3}})[.)]\s|[-•*·ㅇ◦]\s|문항\s?\d{{1,2}}\s)"
    rf"|{_NO_HEAD}\s+(?=(?:{'|'.join(LABEL_HEADS)})[가-힣]{{0,4}}\s?[:：])"
    rf"|{_NO_HEAD}\s+(?=(?:{SECTION_HEADS})(?![가-힣]))"
)

# Deadlines.
DEADLINE_LABELS = (
    "접수기한", "접수 기한", "제출기한", "제출 기한", "마감일시", "마감일",
    "접수기간", "접수 기간", "신청기간", "신청 기간", "모집기간", "모집 기간",
    "지원기간", "지원 기간", "접수", "신청", "모집",
)
DATE = r"(?<!\d)(?:(\d{2,4})\s*[.\-/년]\s*)?(\d{1,2})\s*[.\-/월]\s*(\d{1,2})(?!\d)\s*일?"
TIME = r"\d{1,2}\s*(?::\s*\d{2}|시)"
WINDOW_END = r"결과|발표|통보|지급|증명|발급|활동\s?기간|교육\s?기간|오리엔테이션|급여|지역|근무지|자격요건|우대|전형|서류\s?심사|면접|임용|공고일|시작일|채용\s?인원|문의|응시\s?자격|지원\s?자격|신청\s?자격"
NO_DEADLINE = r"상시\s?모집|선착순|예산\s?소진|수시\s?모집|충원\s?시"
NOT_DATE = r"배수|배율|경쟁률|점수|학점|평점|GPA|%"
ROUND_BEFORE = r"\d\s*차\s*$"
WINDOW_CHARS, MAX_AHEAD_DAYS = 180, 540

# Questions.
CHAR_LIMIT = r"(?:띄어쓰기\s?포함\s?)?(\d{2,5})\s*자\s*(이내|이하|내외|정도|미만|이상)?"
QUESTION_LINE = r"^\s*(?:[-•*]|\d+[.)]|[①-⑩])\s*(.{6,120}?)\s*(?:\(([^)]*자[^)]*)\))?\s*$"
QUESTION_HINT = r"(?:하세요|해\s?주세요|하시오|하십시오|주십시오|주세요|바랍니다|까\??)\s*[.!?]?\s*$"
QUESTION_NOT = (
    r"문의|메일|이메일|연락|전화|홈페이지|링크|다운로드|업로드|첨부|제출\s?(?:방법|서류|처|기한)|접수\s?(?:방법|처|기간)|방문|등기|우편|참고하|확인하|"
    r"(?:참여|지원|관심)\s?(?:부탁|바랍)|많은\s?(?:참여|지원|관심)"
)
SENSITIVE = r"주민\s?(?:등록\s?)?번호|계좌\s?번호|비밀\s?번호|카드\s?번호|여권\s?번호|공인\s?인증|OTP"

# Qualifications and preferences.
QUAL_HEADING = r"지원\s?자격|신청\s?자격|응시\s?자격|참가\s?자격|응모\s?자격|자격\s?요건|지원\s?요건|선발\s?대상|모집\s?대상|참여\s?대상|(?<!취업)지원\s?대상|성적\s?기준|학점\s?기준|이수\s?학점|학년\s?기준"
BULLET_LINE = r"^\s*[-•*▶·ㅇ○◦]\s*"
SECTION_END = r"^[^\n]{0,4}(?:우대\s?(?:사항|조건|요건)?|가점|전형\s?(?:절차|일정|방법)?|제출\s?서류|접수\s?(?:방법|기간)|문의\s?(?:처)?|시상\s?(?:내역|규모)?|유의\s?사항|기타\s?사항)[^\n]{0,8}$"
LINE_SKIP = r"우대|가점|추천\s?인원|모집\s?인원|선발\s?인원|채용\s?인원|배수|합격자?\s?발표|시상|상금|장학금액|지원금|^\s*\d+\s*[.)]\s*[가-힣]{2,8}(?:과|실|팀|부|센터)\s"
QUAL_LINES = 14
YEAR_GRADE = r"(?<!\d)\d\s*학년(?!도)(?:\s*\d\s*학기)?\s*(?:이상|이하|재학|진학|등록|편입)?"
YEAR_SEMESTER = r"(?<!\d)\d\s*~\s*\d\s*학기\s*(?:재학|이상|진학)|(?<!년도\s)(?<!\d)\d\s*학기\s*(?:진학|재학)"
GPA = (
    r"\d\.\d+\s*(?:\(|/)?\s*(?:만점)?[^\n]{0,10}?\d\.\d+\s*(?:학점|점)?\s*이상",
    r"(?:백분위|백분율)[^\n]{0,14}?\d{2,3}(?:\s*/\s*100)?\s*점?\s*이상",
    r"(?:학점|평점|성적)[^\n]{0,14}?\d\.\d+[^\n]{0,12}?(?:이상|만점)",
    r"성적[^\n]{0,12}?\d{2,3}\s*점\s*이상",
)
MAJOR_ANY = r"전공|계열|학과|학부"
MAJOR_FREE = r"전공[^\n]{0,24}?(?:무관|불문|상관\s?없|제한\s?없)"
MAJOR_LABEL = r"전공\s?(?:분야|계열)?\s*[:：]?\s*([가-힣A-Za-z]{2,12}(?:\s?[/,·]\s?[가-힣A-Za-z]{2,12}){1,7})"
MAJOR_ASKED = r"[가-힣A-Za-z]{2,12}(?:\s?[/,·]\s?[가-힣A-Za-z]{2,12}){0,7}(?:\s?관련)?\s?(?:학과(?![장생])|학부(?!생)|전공|계열)"
MAJOR_STOP = (
    "자격요건", "수행업무", "지원자격", "응시자격", "모집", "제한", "무관", "기타", "서류", "전형", "경력", "제외", "졸업예정자", "소지자", "이상", "포함",
)
MAJOR_GENERIC = r"^(?:유관|관련|해당|동일|관계)\s?(?:학과|학부|전공|계열)$"
PREFERENCE_HEADING = r"^[^\n]{0,6}(?:우대\s?(?:사항|조건|요건)|가점|우대)[^\n]{0,10}$"
PREFERENCE_ITEM = rf"^\s*(?:[-•*▶·]|\d+[.)]|[{LIST_SYLLABLES}][.)])\s*(.{{4,80}})\s*$"

# Kinds and signals.
TYPE_HINTS = {
    "scholarship": r"장학(?:금|생|재단|회)|등록금\s?지원|생활비\s?지원",
    "contest": r"공모전|경진\s?대회|해커톤|아이디어\s?공모|콘테스트",
    "activity": r"서포터즈|기자단|대외\s?활동|앰배서더|체험단|봉사단|크리에이터|인플루언서|홍보\s?대사|멘토단",
    "recruit": r"채용|신입\s?사원|인턴|모집\s?부문|경력\s?사원|입사",
}
APPLICABLE = r"모집|선발|접수|신청|지원\s?(?:자격|대상|방법)|응모|참가\s?신청"
ELIGIBILITY = r"자격|대상|요건|조건"
ACADEMIC = r"수강\s?신청|수강\s?바구니|이수\s?의무|이수\s?면제|졸업\s?요건|졸업\s?사정|등록금\s?납부|휴학|복학|성적\s?(?:정정|열람|공시)|학사\s?일정|계절\s?학기|수강\s?정정|시험\s?시간표|등록\s?일정|등록\s?기간|\[등록\]|교과목\s?(?:안내|개설|홍보)|e러닝|취득학점\s?포기"

# The simple heuristic that the rules are compared with.
WORD = r"[A-Za-z가-힣][A-Za-z0-9가-힣+#.]{1,19}"
STOPWORDS = (
    "안내", "공고", "모집", "지원", "신청", "제출", "관련", "대상", "기간", "문의", "첨부", "이상", "이하", "및", "또는", "경우", "해당", "가능", "위한", "통해", "있는", "있습니다", "합니다",
    "바랍니다", "주시기", "학년", "학점", "우대", "마감", "접수", "채용", "장학금", "공모전", "대외활동", "내용", "예정", "진행", "운영",
)
PLAIN_DATE = r"(20\d{2})[.\-/년]\s?(\d{1,2})[.\-/월]\s?(\d{1,2})"
PLAIN_SHORT_DATE = r"[~까지]\s?(\d{1,2})\s?[/월]\s?(\d{1,2})"
PLAIN_QUESTION = r"^[ \t]*(\d)[.)]\s*(.{5,120}?)\s*(?:\((\d{2,5})자[^)]*\))?\s*$"
PLAIN_CUES = ("?", "작성", "기술", "서술", "주세요")
PLAIN_YEAR, PLAIN_GPA, PLAIN_MAJOR = r"(\d)\s?학년\s?(?:이상|재학)", r"(?:학점|평점)\s?(\d\.\d+)\s?(?:이상)?", r"([가-힣]{2,10}(?:학과|학부|전공|계열))"

# Guards.
NUMBER = r"\d+(?:[.,]\d+)?\s*(?:%|년|개월|명|건|위|등|배|회|점|만|억|원|시간|일|주)?"
LATIN = r"[A-Za-z][A-Za-z0-9+#./-]{1,}"
TOKEN = r"[A-Za-z0-9+#.]{2,}|[가-힣]{2,}"
TRAILING = r"[\s.!?。~\"'”’」』)\]]+$"
ENDINGS = {"formal": r"(?:니다|십니까)$", "confident": r"(?:니다|십니까)$", "casual": r"(?:요|죠)$"}
SPELLINGS = {
    "타입스크립트": ("typescript",), "자바스크립트": ("javascript",), "리액트": ("react",), "스프링부트": ("springboot",), "스프링": ("spring",),
    "쿠버네티스": ("kubernetes", "k8s"), "도커": ("docker",), "레디스": ("redis",), "카프카": ("kafka",), "파이썬": ("python",), "코틀린": ("kotlin",),
    "자바": ("java",), "피그마": ("figma",), "텐서플로": ("tensorflow",), "파이토치": ("pytorch",), "리눅스": ("linux",), "젠킨스": ("jenkins",),
    "테라폼": ("terraform",), "그라파나": ("grafana",), "언리얼": ("unreal",), "유니티": ("unity",), "깃허브": ("github",), "유튜브": ("youtube",),
    "틱톡": ("tiktok",), "인스타그램": ("instagram",),
}
NOT_SPELLINGS = ("스프링클러",)
CLAIMS = {
    "자격": ("자격증", "면허", "수료증", "인증서", "취득", "기사"),
    "수상": ("수상", "최우수", "우수상", "장려상", "입상", "금상", "은상", "대상을 받", "대상 수상"),
    "소속": ("입사", "재직", "근무 경험", "정규직", "인턴십을 수료"),
}
OUTCOMES = {
    "반응": (("만족도", "호평", "피드백을 받", "좋은 반응", "긍정적인 반응", "칭찬", "감사 인사", "감사의 인사"), r"만족|호평|피드백|반응(?!형)|칭찬|감사|후기|설문"),
    "인정": (("인정을 받", "인정받", "높은 평가"), r"인정|평가|수상|입상|우승|\d+\s?위"),
}
FUTURE, ADNOMINAL = r"겠|싶|예정|계획|고자", r"([가-힣])\s?(?:것|수\s?있(?!었))"
DISCRIMINATORY = {
    "신체조건": r"용모\s*(?:단정|수려|준수)|신체\s?조건|(?:키|신장)\s*\d{3}|체중\s*\d{2}|(?:키|신장|체중)\s*(?:제한|기준)",
    "혼인": r"미혼\s*(?:자|인|여성|남성|에\s?한|만)|기혼\s*(?:자|여성|남성)|혼인\s*(?:여부|상태|관계)|결혼\s*(?:여부|유무)",
    "출신지역": r"출신\s?지역|본적지|거주지\s*제한|(?:서울|수도권)\s*거주자에\s*한",
    "가족": r"(?:부모|모친|부친|가족|보호자)(?:님)?의?\s*(?:직업|재산|소득|학력|근무)|직계\s?존비속|형제자매의\s*(?:직업|학력)",
    "성별지정": r"(?:남자|여자|남성|여성)\s*(?:만|에\s?한(?:함|해)|우대|지원\s?가능)|성별\s*[:：]\s*(?:남|여)",
}
BLOCKED = ("씨발", "시발", "좆", "병신", "븅신", "새끼", "지랄", "닥쳐", "꺼져", "찐따", "틀딱", "맘충", "김치녀", "한남충", "급식충", "장애인 같", "애자")
CAPABILITY = "(?:능력|역량|전문성|실력)"
EXCERPT = "과거 자소서 발췌:"
HEDGES = ("부족하지만", "부족하나", "감히", "미숙하지만", "미흡하지만", "나름대로", "조금이나마")
CLICHES = ("라고 생각합니다", "하였습니다", "생각됩니다", "것 같습니다")
MAX_KEYWORDS, MIN_KEYWORDS, MAX_QUESTIONS, MAX_SENTENCES, SHORT_GROUND, DEFAULT_DRAFT = 10, 3, 10, 2, 3, 600

# Sentences of the draft that quotes its inputs, by tone: with a title, without, after an experience, at the end, without any experience.
DRAFT = {
    "casual": ("{title}에 지원해요.", "이 질문에 제 경험으로 답해 볼게요.", "경험이 있어요.", "이 경험을 바탕으로 맡은 일을 성실히 해내고 싶어요.", "등록된 경험 카드가 없어 근거가 되는 사실을 넣지 못했어요. 경험 카드를 등록한 뒤 다시 생성하면 그 내용으로 초안을 써요."),
    "confident": ("{title}에 지원합니다.", "{question}에 대해 말씀드리겠습니다.", "경험이 있습니다.", "이 경험으로 맡은 역할을 해낼 수 있습니다.", "등록된 경험 카드가 없어 근거가 되는 사실을 넣지 못했습니다. 경험 카드를 등록한 뒤 다시 생성하면 그 내용으로 초안을 작성합니다."),
    "formal": ("{title}에 지원합니다.", "{question}에 대해 말씀드리겠습니다.", "경험이 있습니다.", "이 경험을 바탕으로 맡은 역할을 성실히 수행하겠습니다.", "등록된 경험 카드가 없어 근거가 되는 사실을 넣지 못했습니다. 경험 카드를 등록한 뒤 다시 생성하면 그 내용으로 초안을 작성합니다."),
}
STUB_SENTENCE = "(더미 응답) 지원 분야와 맞닿은 경험을 바탕으로 기여하고자 합니다. "

# Scores, prices, codes.
COSINE_ZERO, COSINE_FULL = 0.365, 0.509
PRICES = {"HCX-DASH-002": (0.00025, 0.001), "HCX-005": (0.00125, 0.005), "HCX-007": (0.00125, 0.005)}
STATUS = {"INVALID_INPUT": 400, "RATE_LIMITED": 429, "LLM_UNAVAILABLE": 503}
DEADLINE_S, CACHED_S, FIRST_S, SPARE_S = 16.0, 0.2, 3.0, 1.0
# Reports.
MAX_LINES, TONE_TARGET, REGEN_SIMILAR = 3, 0.8, 0.5

# ---- End of the fixed values. ----
