"""Problem 1: defects of prompt and response pairs.

Ordered rules per answer: emptiness, refusal phrases of many languages, copied prompt or
question, script and language mismatch, and abrupt or unclosed endings.  Every triggered
defect comes out with its rank; the first is the answer's defect.  Whole texts are judged,
whatever their length.

How list items end is learned from all answers of the table: for each word that stands in
enough items, how often it is the last one.  Words are counted map-side and only those in
``COMMON_SHARE`` of the items are kept, so what travels back is bounded by the words of
``1 / COMMON_SHARE`` items.  Judging is a narrow map.
"""

from __future__ import annotations

import functools
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.core.runtime import cut

ORDER = ("empty", "refusal", "copy", "language", "truncated")

_MARKUP = re.compile(r"<[^<>]{1,40}>|```[a-z]*|[\s​‌‍⁠﻿­]+")
_NO_ANSWER = re.compile(r"(?:n\s*[/.]?\s*a\.?|null|nil|none|nan|undefined|tbd|todo|empty|blank|answer|response|output|\W*)", re.I)
_NO_RELATION = re.compile(r"\(\s*none\s*\)", re.I)

# Phrases that decline to answer.
_REFUSALS = re.compile(
    r"\b(?:i(?:'m| am|’m)? (?:really )?(?:sorry|afraid)\b.{0,60}?\b(?:can(?:'t|’t|not)|unable|not able|won(?:'t|’t)|not|decline|outside|against)|"
    r"i (?:can(?:'t|’t|not)|could not|couldn't|won(?:'t|’t)|will not) (?:be able to )?(?:help|assist|answer|provide|comply|extract|process|complete|do|discuss|share|fulfil|give|respond|comment|offer|engage|support)|"
    r"i(?:'m|’m| am) (?:unable|not able|not in a position|not comfortable|not permitted|not allowed|prevented)|i (?:must|have to|need to|will|respectfully) (?:respectfully )?(?:decline|refuse)|i decline|i refuse|"
    r"i don(?:'t|’t) feel comfortable|falls? outside (?:of )?what i can|(?:would|is) not (?:be )?appropriate for me|(?:would )?(?:go|goes) against my (?:guidelines|policy|policies)|beyond my (?:scope|capabilities)|"
    r"as an? (?:ai|artificial|large )?\s*(?:language model|ai|assistant)\b.{0,80}?\b(?:can|unable|not|won|must|decline)|"
    r"no puedo (?:ayudar|responder|contestar|proporcionar|procesar|atender|cumplir|ofrecer|dar|extraer)|no me es posible|lo siento\b|lamento no|no estoy en condiciones|debo (?:declinar|rechazar)|"
    r"je (?:suis (?:vraiment )?désolé|ne (?:peux|puis|suis) pas (?:répondre|vous aider|aider|en mesure|fournir|traiter|autorisé|donner)|regrette|dois (?:décliner|refuser))|désolé, (?:mais )?je|il m'est impossible|"
    r"es tut mir leid|(?:dabei|dazu|damit|hier|das) kann ich (?:ihnen )?(?:leider )?(?:nicht|keine)|ich kann (?:ihnen |dir )?(?:diese |dabei |dazu |das |leider |bei |dies )*.{0,30}?nicht (?:helfen|beantworten|weiterhelfen|bearbeiten)|ich bin nicht in der lage|ich muss (?:das |dies )?ablehnen|leider kann ich|"
    r"mi dispiace|non posso (?:aiutare|rispondere|fornire|elaborare)|non sono in grado|"
    r"(?:lamento|desculpe|sinto muito)\b|não posso (?:ajudar|responder|fornecer)|não consigo (?:ajudar|responder))",
    re.I | re.S,
)
_REFUSALS_OTHER = re.compile(r"申し訳(?:ありません|ございません)|(?:お答え|回答|対応|お手伝い|提供)(?:することは|は)?(?:でき(?:ません|ない|かねます)|いたしかねます)|抱歉|(?:我)?(?:无法|不能|無法)(?:回答|提供|处理|协助|帮助|满足|完成)|很遗憾，我|عذر[اًا]|آسف|لا (?:يمكنني|أستطيع)|क्षमा करें|माफ़ कीजिए|मैं .{0,30}(?:असमर्थ|नहीं कर सकत)|ขออภัย|ไม่สามารถ(?:ตอบ|ช่วย|ให้)|извините|не могу|죄송|(?:답변|도와).{0,10}(?:수 없|드릴 수)")
_SENTENCE = re.compile(r"(?<=[.!?。！？؟।])\s*(?=\S)")

# Frequent function words by language.
_SMALL = {
    "en": "the of and to by is are was were its from so no would has have had for with at that not it be been on an a their they which who does did do this these those there up first last after before only under will can could should than then when where while because into over about between both each if as or but he she we you his her our your",
    "de": "der die das und von ist im den dem des ein eine einer eines einem einen mit für auf bei nach seiner seine sein ihre ihr nicht wird wurde werden wurden sind war waren aus zu zum zur es sie er wir ich sich auch als an am um bis durch gegen ohne über unter vor zwischen dass daß weil wenn wie was wer wo noch nur schon sehr kann kein keine haben hat hatte oder aber rund daher wäre",
    "fr": "le la les l des et est de du d un une dans par pour avec qui que à au aux en sur ses son sa leur leurs ne pas ce cette ces cet dont sont été être a ont avait il elle ils elles nous vous je on se si ou où mais plus moins comme très après avant sans sous entre chez donc car aussi tout tous toute",
    "es": "el la los las lo y es de del un una unos unas en por para con que a al su sus se no como más pero sin sobre entre este esta estos estas ese esa muy ya también fue ser son está están ha han había hay o u cuando donde quien porque desde hasta si le les me nos yo ella ellos ciento",
    "it": "il lo la gli le i e è di del della dello delle dei degli da dal dalla dai un uno una in nel nella per con che a al alla ai su sul sulla sono non si ci ha hanno era erano essere stato questo questa questi anche come più ma se o dove quando perché tra fra suo sua suoi loro cento circa",
    "pt": "o a os as e é de do da dos das um uma uns umas em no na nos nas por pelo pela para com que ao à aos às se não mais mas como seu sua seus suas este esta isto esse essa foi ser são está estão tem têm há ou quando onde porque já também muito entre sem sobre até desde ele ela eles cento cerca",
    "nl": "de het een en van is in op voor met dat niet zijn door aan bij te uit er om als naar ook maar dan of zij hij wij ik je deze dit die wordt werd worden heeft hebben had was waren kan geen nog wel tot over onder tussen tegen zonder omdat wat wie waar hun haar procent",
    "pl": "i w z na do się jest są był była było od przez nie że o dla po za ze jak ale lub czy co to ten ta te tego tej tym oraz jego jej ich może być który która które przed bez pod nad między tylko już także gdy",
    "sv": "och i att det som en ett av är på för med till den de inte var har hade kan ska om men eller så från vid under över efter utan mellan sin sitt sina han hon vi ni jag detta denna dessa också bara när där vad hur blir blev",
    "da": "og i at det som en et af er på for med til den de ikke var har havde kan skal om men eller så fra ved under over efter uden mellem sin sit sine han hun vi jeg dette denne disse også kun når hvor hvad hvordan bliver blev",
    "no": "og i å det som en et av er på for med til den de ikke var har hadde kan skal om men eller så fra ved under over etter uten mellom sin sitt sine han hun vi jeg dette denne disse også bare når hvor hva hvordan blir ble",
    "fi": "ja on ei se että oli olla ovat joka mutta tai kun kuin niin myös hän ne sen tämä tämän nämä jos vain vielä jo kanssa sekä ovat eivät ole mitä missä koska ennen jälkeen ilman noin sitä hänen heidän me te minä",
    "tr": "ve bir bu için ile da de çok daha en gibi kadar olarak olan oldu ne ama veya ki o şu her sonra önce göre değil var yok mi mı ise ancak hem tarafından üzerinde arasında yüzde",
    "cs": "a je v na se že to s z do o i ve za po pro jako ale by jsou byl byla bylo jeho její jejich od při podle mezi bez nebo jen už také který která které když jak aby není má",
    "hu": "a az és hogy nem is egy van volt meg de ha csak mint már még ez azt ezt vagy lesz volna mert minden után előtt között nélkül szerint",
    "ro": "și în de la cu pe nu este sunt un o din pentru că mai care ca se a ai al ale fi fost sau dar prin după până fără între către această acest",
    "id": "yang dan di dari untuk dengan pada ini itu tidak adalah akan oleh dalam ke juga atau karena sebagai telah dapat lebih sudah bisa ada mereka kami saya",
    "vi": "và của là có trong cho được không với các một những này đã để từ người khi tại vào về như đến theo cũng nhiều",
}
_SMALL_SETS = {k: frozenset(v.split()) for k, v in _SMALL.items()}
_NAMES = {"english": "en", "german": "de", "french": "fr", "spanish": "es", "italian": "it", "portuguese": "pt", "dutch": "nl", "japanese": "ja", "chinese": "zh", "korean": "ko", "arabic": "ar", "hindi": "hi", "thai": "th", "russian": "ru", "polish": "pl", "turkish": "tr", "swedish": "sv", "danish": "da", "norwegian": "no", "finnish": "fi", "czech": "cs", "hungarian": "hu", "romanian": "ro", "indonesian": "id", "vietnamese": "vi"}
_TARGET = re.compile(r"\b(?:in|into|to)\s+(?:simple |plain )?(" + "|".join(_NAMES) + r")\b", re.I)
_SCRIPTS = (("ja", re.compile(r"[぀-ヿ]")), ("ko", re.compile(r"[가-힯]")), ("zh", re.compile(r"[㐀-鿿]")), ("ar", re.compile(r"[؀-ۿ]")), ("hi", re.compile(r"[ऀ-ॿ]")), ("th", re.compile(r"[฀-๿]")), ("ru", re.compile(r"[Ѐ-ӿ]")), ("el", re.compile(r"[Ͱ-Ͽ]")), ("he", re.compile(r"[֐-׿]")))
_LETTERS = re.compile(r"[^\W\d_]+")
_LOWER = re.compile(r"(?<![^\W\d_])[^\W\d_]+(?![^\W\d_])")
_QUOTE_TASK = re.compile(r"\bquote\b|word for word|verbatim|copy out|wörtlich|mot à mot|palabra por palabra", re.I)
_END = re.compile(r"[.!?。！？؟।][\"'”’»」』)\]]*$")
_GRAPH_LINE = re.compile(r"^\(.*\)\s*<?-\s*\[.*\]\s*->?\s*\(.*\)\s*;?$")
_ITEM = re.compile(r"^\s*(?:\d+[.)]|[-*•])\s+")
_DANGLING = frozenset("of for by at the a an in on with to from and or per is are its under than as that which".split())
_ASKED = re.compile(r"\b(?:list|name|give|identify|state|find|write|mention|provide|top|the)\s+(?:\w+\s+){0,3}?(two|three|four|five|six|seven|eight|nine|ten)\b", re.I)
_NUMBERS = {w: i for i, w in enumerate("two three four five six seven eight nine ten".split(), 2)}
#: A word counts as known in list items if it stands in this share of them and in so many.
COMMON_SHARE, COMMON_ITEMS = 0.002, 10
#: A known word that ends fewer of its items than this ends an item only where it breaks off.
ENDING_SHARE = 0.2
_NAME_WORDS = frozenset("and of plc de la the & du von y et e".split())


_BEYOND_LATIN = re.compile(r"[Ͱ-\u1fff぀-퟿]")
_OF_WORD: dict[str, tuple] = {}
for _lang, _set in _SMALL_SETS.items():
    for _w in _set:
        _OF_WORD[_w] = (*_OF_WORD.get(_w, ()), _lang)


def language_of(text: str) -> tuple[str | None, float]:
    """Most likely language and the number of words (or 3 for a script) that speak for it."""
    if not text.isascii() and _BEYOND_LATIN.search(text):
        letters = sum(map(len, _LETTERS.findall(text))) or 1
        for lang, p in _SCRIPTS:
            hits = len(p.findall(text))
            if hits >= 2 and hits * (8 if lang in ("ja", "zh", "ko") else 3) >= letters or hits >= 8:
                return lang, 3.0 + hits
    score: dict[str, float] = {"en": 0.01}
    for w in _LOWER.findall(text.lower()):
        for lang in _OF_WORD.get(w, ()):
            score[lang] = score.get(lang, 0) + 1
    best = max(score, key=score.get)
    return (best, score[best]) if score[best] >= 2 else (None, score[best])


def _score(text: str, lang: str) -> int:
    small = _SMALL_SETS.get(lang)
    return sum(w.lower() in small for w in _LOWER.findall(text)) if small else 0


def _frame(prompt: str) -> str:
    """First and last line of the prompt: where the task is put."""
    lines = [x for x in prompt.strip().split("\n") if x.strip()]
    return "\n".join({lines[0]: 1, lines[-1]: 1}) if lines else ""


def _units(text: str) -> list[str]:
    """Comparable words; scripts without spaces give single characters."""
    return re.findall(r"[぀-ヿ㐀-鿿฀-๿]|[^\W_]+", text.lower())


def _grams(words: list[str], n: int = 2) -> list[tuple]:
    return list(zip(*[words[i:] for i in range(n)])) if len(words) >= n else [tuple(words)] if words else []


class Prompt:
    """What the rules need to know of a prompt, each worked out when first wanted."""

    def __init__(self, text: str):
        self.text = text

    @functools.cached_property
    def frame(self) -> str:
        return _frame(self.text)

    @functools.cached_property
    def quote(self) -> bool:
        return bool(_QUOTE_TASK.search(self.frame))

    @functools.cached_property
    def language(self) -> str | None:
        """The language that the task names, else the one it is put in."""
        target = _TARGET.findall(self.frame)
        if target:
            return _NAMES[target[-1].lower()]
        return language_of(self.frame)[0] or language_of(self.text)[0]

    @functools.cached_property
    def units(self) -> list[str]:
        return _units(self.text)

    @functools.cached_property
    def asks(self) -> list[list[str]]:
        lines = [x for x in self.text.strip().split("\n") if x.strip()]
        ends = lines[:1] + lines[-1:]
        parts = ends + [re.split(r"[:：]\s*", x, maxsplit=1)[-1] for x in ends] + [re.split(r",\s+", x, maxsplit=1)[-1] for x in ends[-1:]]
        return [u for u in (_units(x) for x in dict.fromkeys(parts)) if len(u) >= 3]


def is_empty(answer: str | None) -> bool:
    """Nothing that carries an answer; a stated absence of relations is one."""
    if answer is None:
        return True
    if _NO_RELATION.fullmatch(answer.strip()):
        return False
    return bool(_NO_ANSWER.fullmatch(_MARKUP.sub("", answer)))


def is_refusal(answer: str) -> bool:
    """Whether a refusal opens or closes the answer: it stands in its first two sentences or its last."""
    if answer.lstrip()[:1] in "{[(":
        return False
    sentences = _SENTENCE.split(answer.strip())
    told = answer if len(sentences) <= 3 else " ".join(sentences[:2]) + "\n" + sentences[-1]
    return bool(_REFUSALS.search(told) or _REFUSALS_OTHER.search(told))


def is_copy(answer: str, prompt: Prompt) -> bool:
    """Whether the answer gives back the prompt from its start, or its question."""
    if answer.lstrip()[:2] in ('{"', "(:"):
        return False
    a = _units(answer)
    if len(a) < 4:
        return False
    mine = _grams(a)
    words = set(a)
    for q in prompt.asks:
        if 0.6 * len(q) <= len(a) <= 1.5 * len(q) and sum(w in words for w in q) >= 0.6 * len(q):
            have = set(_grams(q))
            if sum(g in have for g in mine) >= 0.72 * len(mine) and not (prompt.quote and _is_one_sentence(answer, prompt)):
                return True
    if len(a) < 12 or not _near_start(a, prompt.units):
        return False
    have = set(_grams(prompt.units[: int(len(a) * 1.15) + 4]))
    # a quoted sentence is no copy unless it runs on far beyond one
    if sum(g in have for g in mine) < 0.88 * len(mine) or prompt.quote and not _takes_the_task(a, prompt):
        return False
    return not _is_one_sentence(answer, prompt)


def _near_start(a: list[str], head: list[str]) -> bool:
    return sum(x in head[: len(a[:8]) + 3] for x in a[:8]) >= 6 if len(a) >= 8 else False


def _takes_the_task(a: list[str], prompt: Prompt) -> bool:
    ask = set(prompt.asks[0]) if prompt.asks else set()
    return bool(ask) and sum(x in ask for x in a[: len(ask)]) >= 0.7 * min(len(ask), len(a)) or len(a) > 90


def _is_one_sentence(answer: str, prompt: Prompt) -> bool:
    """A single complete sentence of the passage serves as an answer."""
    s = answer.strip().strip("“”\"«»„")
    return len(re.findall(r"[a-zà-ÿ\d)][.!?](?=\s+[A-ZÀ-Ý])", s)) == 0 and bool(_END.search(s)) and s[:1].isupper() and s in prompt.text


def wrong_language(answer: str, prompt: Prompt) -> bool:
    s = answer.strip()
    if s[:1] in "{[(" or prompt.language is None:
        return False
    lang, score = language_of(answer)
    if lang is None or lang == prompt.language:
        return False
    if lang in _SMALL_SETS and prompt.language in _SMALL_SETS:
        return score >= 3 and score >= 1.4 * _score(answer, prompt.language)
    if lang in _SMALL_SETS:  # Latin answer where another script is asked for
        return score >= 3
    return True


def is_truncated(answer: str, prompt: Prompt, endings: dict | None = None) -> bool:
    s = answer.rstrip()
    if not s:
        return False
    if s.endswith(("…", "...")) and len(s) > 3:
        return True
    body = s.lstrip()
    if body[0] in "{[" and not body.startswith("[["):
        try:
            json.loads(body)
            return False
        except ValueError:
            return True
    if body[0] == "(" and body[1:2] in (":", "`") or body.startswith("(") and "-[" in body:
        return not all(_GRAPH_LINE.match(x.strip()) and _balanced(x) for x in body.split("\n") if x.strip())
    if body.count("```") % 2 or body.count("“") + body.count("„") > body.count("”") + body.count("“") * (body.count("„") > 0) or body.count("«") > body.count("»") or body.count("「") > body.count("」"):
        return True
    lines = [x for x in body.split("\n") if x.strip()]
    if sum(bool(_ITEM.match(x)) for x in lines) >= max(1, len(lines) - 1) and _ITEM.match(lines[0]):
        return _list_breaks_off(lines, prompt, endings or {})
    if _END.search(s):
        return False
    if re.search(r"[぀-ヿ㐀-鿿]", s):
        return len(s) >= 10 and len(re.findall(r"[぀-ヿ㐀-鿿]", s)) >= 4
    words = re.findall(r"\S+", s)
    prose = [w for w in words if w[0].islower() and w.lower().strip(",;:") not in _NAME_WORDS]
    if len(words) <= 3:
        return words[-1].lower() in _DANGLING or s[-1] in ",;:-" and len(words) > 1
    return len(prose) >= 2 or s[-1] in ",;-" or words[-1].lower() in _DANGLING


def _balanced(x: str) -> bool:
    return all(x.count(a) == x.count(b) for a, b in ("()", "[]", "{}")) and x.count('"') % 2 == 0


def _list_breaks_off(lines: list[str], prompt: Prompt, endings: dict[str, tuple[int, int]]) -> bool:
    """Fewer items than asked for, or a last item that ends in mid phrase or mid word.

    ``endings``: of each known word, in how many items it stands and how many it ends.
    """
    asked = _ASKED.search(prompt.frame)
    items = sum(bool(_ITEM.match(x)) for x in lines)
    if asked and items < _NUMBERS[asked.group(1).lower()]:
        return True
    last = _ITEM.sub("", lines[-1]).strip() if _ITEM.match(lines[-1]) else re.sub(r"^\s*(?:\d+[.)]?|[-*•])\s*$", "", lines[-1]).strip()
    if not last:
        return True
    if _END.search(last):
        return False
    words = last.split()
    w = words[-1].lower()
    if w in _DANGLING or last[-1] in ",;:-(":
        return True
    if w in endings:
        n, ends = endings[w]
        return ends < ENDING_SHARE * n
    follow = re.findall(rf"(?<!\w){re.escape(words[-1])}(?!\w)([^\w\s]*\s+\S+|[^\w\s])?", prompt.text)
    if not follow:  # not a word of the prompt: broken off if it begins one, or a known word
        return re.search(rf"(?<!\w){re.escape(words[-1])}\w", prompt.text) is not None or any(v.startswith(w) for v in endings)
    # a part of a name: wherever it stands, another capital follows
    return words[-1][0].isupper() and all(re.match(r"\s+[A-Z&]", f or "") for f in follow) and not re.fullmatch(r"(?:Inc|Corp|Ltd|LLC|AG|plc|S\.A|N\.V)\.?|Company|Corporation|Incorporated|Limited", words[-1])


def item_words(answer: str | None) -> list[tuple[str, bool]]:
    """``(word, ends its item)`` of the items of a list answer; each word once an item."""
    lines = [x for x in (answer or "").split("\n") if _ITEM.match(x)]
    out = []
    for x in lines:
        words = [w.lower() for w in _ITEM.sub("", x).split() if not any(c.isdigit() for c in w)]
        out += [(w, False) for w in set(words[:-1]) - set(words[-1:])] + [(w, True) for w in words[-1:]]
    return out


def learn_endings(rows: DataFrame, fields: list[str]) -> dict[str, tuple[int, int]]:
    """Of each word in ``COMMON_SHARE`` of all list items: in how many it stands and how many it ends."""

    def run(it):
        from collections import Counter

        n, ends = Counter(), Counter()
        for b in it:
            for c in b.columns:
                for answer in c.to_pylist():
                    for w, last in item_words(answer):
                        n[w] += 1
                        ends[w] += last
                        n[""] += last
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([ends[w] for w in n], pa.int64())], ["word", "n", "ends"])

    per = rows.select(*[F.col(f).alias(f"_{i}") for i, f in enumerate(fields)]).mapInArrow(run, "word string, n long, ends long")
    per = cut(per.groupBy("word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")))
    whole = per.where("word = ''").agg(F.max("n")).first()[0] or 0
    known = per.where((F.col("word") != "") & (F.col("n") >= max(COMMON_ITEMS, COMMON_SHARE * whole)))
    return {r["word"]: (r["n"], r["ends"]) for r in known.collect()}


def defects(prompt: Prompt, answer: str | None, endings: dict | None = None) -> list[str]:
    """All triggered defects in order of rank; none after emptiness."""
    if is_empty(answer):
        return ["empty"]
    out = []
    if is_refusal(answer):
        out.append("refusal")
    if is_copy(answer, prompt):
        out.append("copy")
    if wrong_language(answer, prompt):
        out.append("language")
    if is_truncated(answer, prompt, endings):
        out.append("truncated")
    return out


def find_defects(rows: DataFrame, tbl: str, fields: list[str], key: str = "record_no", prompt: str = "prompt") -> DataFrame:
    """``(tbl, key, field, defect, rank)``: every triggered defect of every field, rank from 1.

    A null prompt counts as empty text; a null answer is empty.
    """
    endings = learn_endings(rows, fields)

    def run(it):
        for b in it:
            cols = [b.column(2 + i).to_pylist() for i in range(len(fields))]
            who, field, what, rank = [], [], [], []
            for i, p in enumerate(b.column(1).to_pylist()):
                pr = Prompt(p or "")
                for f, c in zip(fields, cols):
                    for r, d in enumerate(defects(pr, c[i], endings), 1):
                        who.append(i)
                        field.append(f)
                        what.append(d)
                        rank.append(r)
            yield pa.RecordBatch.from_arrays(
                [pa.array([tbl] * len(who), pa.string()), b.column(0).take(pa.array(who, pa.int64())), pa.array(field, pa.string()), pa.array(what, pa.string()), pa.array(rank, pa.int32())],
                ["tbl", "record_no", "field", "defect", "rank"],
            )

    x = rows.select(F.col(key).cast("long").alias("record_no"), F.col(prompt).alias("_p"), *[F.col(f).alias(f"_{i}") for i, f in enumerate(fields)])
    return x.mapInArrow(run, "tbl string, record_no long, field string, defect string, rank int")
