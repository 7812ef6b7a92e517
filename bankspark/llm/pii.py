"""Personal information in free text: found, typed and replaced by placeholders.

Method: a semi-Markov conditional random field over each line. Candidate segments of bounded length (mail
addresses, digit groups, house numbers with streets, all pairs and triples of capitalised words, also with a
particle between) carry whole-span features: shape, parts in word lists, the words around, the address beside a
name; a segment that stands right behind another also carries a transition feature of the two kinds and what is
between them. No list decides what is a candidate: a name of words in no list is told by what stands around it.
Dynamic programming over segments chooses boundaries and types together. The weights are fitted by gradient
ascent on the conditional log-likelihood of labelled lines that are generated here from frames and invented
words (TRAIN_LINES of them, a documented bound); the model is fitted once on the driver and is a few hundred
numbers. Tests hold out frames and given names.

Defined results: null and empty texts have no values and stay as they are; spans do not cross line ends;
repeated values of a field are one value; all lines of a text are read.
"""

from __future__ import annotations

import bisect
import functools
import math
import random
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bankspark.llm.names import FIRM, NICKNAMES
from bankspark.runtime import spread

TRAIN_LINES, EPOCHS, RATE, DECAY = 4000, 10, 0.3, 1e-4
KINDS = ("email", "phone", "id_number", "street", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street": "[STREET]", "name": "[NAME]"}

AT = r"(?:@|\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?|\s(?:at|AT)\s)"
DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s)"
EMAIL = re.compile(rf"[A-Za-z0-9][\w.+%'-]*(?:@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|{AT}[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)+)")
DIGITS = re.compile(r"(?:\+|\(\+?)?\d+(?:(?:[ .-]|\) ?| ?\(|\)-)\d+)*")
GROUP = re.compile(r"(?:\+|\(\+?)?\d+")
CODED = re.compile(r"(?<![\w-])(?!(?:PO|ID|NI|NO|NR|TO|IS|OF|ON|AT|IN|BY|AM|PM|OR)\b|Q[1-4] (?:19|20)\d\d\b)(?:(?:[A-Z]{2}[- ]?|[A-Z]-?)\d(?:[\d -]{2,12}\d)(?: ?[A-Z])?|\d{2}-\d{7})(?![\w-])")
STREET_TYPE = r"(?:Streets?|St|Road|Rd|Lane|Ln|Avenue|Ave\.|Ave|Boulevard|Blvd|Court|Ct|Place|Pl|Drive|Dr|Way|Square|Sq|Close|Terrace|Crescent|Row|Walk|Hill|Gardens|Parkway|Pkwy|Highway|Hwy)"
STREET = re.compile(
    rf"(?<![\w-])\d{{1,5}}(?:[-–]\d{{1,5}})?[a-zA-Z]?,?\s(?:[NSEW]\.?\s)?(?:[A-Z][\w'’-]*\.?\s){{1,3}}{STREET_TYPE}(?!\w)"
    r"|(?<![\w-])\d{1,5}(?:bis|ter)?,?\s(?:rue|avenue|boulevard|place|quai|chemin|allée|via|calle|rua)\s(?:(?:de|du|des|la|le)\s)*[A-Z][\w'’-]*(?:\s[A-Z][\w'’-]*)?"
    r"|(?<!\w)[A-Z][\w'’-]*(?:stra(?:ss|ß)e|str\.|weg|platz|gasse|allee|ring|damm|ufer)\s\d{1,4}(?:\s?[a-z])?(?!\w)"
    r"|(?<!\w)P\.?\s?O\.?\sBox\s\d{1,6}|(?<!\w)(?:Postfach|Apartado|Boîte postale|Caixa postal)\s\d{1,6}",
)
NINE = re.compile(r"\d{3}([- ]?)\d{2}\1\d{4}")
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:['’-][^\W\d_]+)*\.?")

#: Given names beside those that nicknames stand for.
GIVEN = set(
    "akiko amir ana anders anna ben bjorn bram carlos chen chloe claire diego dmitri elena emil emma erik eva farid fatima femke finn gunnar hamid hans hassan helga henrik hiroshi hugo ines ingrid ivan jose juan jurgen kai karen karin karl kenji kofi kwame lars laura lena linh lucas luis maren maria marie mark marta "
    "martin mei mohamed nadia nils noor olaf olga omar oskar pablo paul paula pedro pierre priya rahul raj rene rosa sanjay sara sofia sonja soren stefan sven tariq thomas ulla ulrich viggo walter wei wen xenia yuki yusuf yvonne zoe esther".split()
) | {g for v in NICKNAMES.values() for g in v}
#: Words that begin sentences, greet, name days, months, places, firms or tasks and are no family names.
COMMON = set(
    "pm a all am and as ask at before best bill box build call can cc cheers close confidential contact copy date dear deliver desk don either el en fax fe for forwarded from fyi get good half hello hi his her hold i id if in interview invoice is it keep kind la le leave many may meet message mister mobile mr mrs ms my no nobody not nous of offers on or our per phone please private "
    "po re read regards registered reply ring room see send sender sent she since sincerely some staff subject such suite talk tax tel text thank thanks that the their there this ticket to use von was we what when who will with write yours yes you your "
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz mai juni juli oktober dezember jan feb mar apr jun jul aug sep oct nov dec mon tue wed thu fri sat sun "
    "terminal junction ridge quay loop basin works plant storage crossing relay project station board class stage suite star blend lines rule group hall north south east west grid services service freight marine power gas grain rail timber steel pipeline logistics brokers supply partners company department management exchange authority insurance association engineering manufacturing international legal credit port yard bank "
    "metering agent lead claims handler senior scheduler reviewer dispatch clerk trading support assistant records manager site engineer supervisor analyst tariff road street lane court place avenue blvd box original new old next last first".split()
) | FIRM
ROLE_BEFORE = set("ask with to cc by of from interview contact spoke attn attention dear hi hello for and von schrieb met called said de à an dr mr mrs ms prof herr frau".split())
ROLE_AFTER = set("wrote said says writes will has wants or about is a schrieb escribió called asked signed first next".split())
TITLE = set("dr mr mrs ms miss prof sir herr frau".split())
PHONE_CUE = set("t tel telephone phone ph mobile mob cell fax call ring text line callback number reach me on to at direct left is".split())
ID_CUE = set("insurance national payroll pension visa permit driving ssn id passport licence license tax staff employee number social security reference badge reads no is use ni driver".split())
STRONG_ID_CUE = set("insurance ssn passport licence license tax staff employee social security ni id reference".split())
CODE_CUE = set("po lot invoice meter ticket build rate part order account item serial ref version room rev week no section batch".split())


@functools.lru_cache(100_000)
def fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word.replace("ø", "o").replace("Ø", "O")) if not unicodedata.combining(c)).lower().rstrip(".")


@functools.lru_cache(100_000)
def word_kind(word: str) -> str:
    """G given name, N nickname, I initial, C common word, F any other capitalised word."""
    w = fold(word)
    if len(w) == 1:
        return "I"
    if w in GIVEN:
        return "G"
    if w in NICKNAMES:
        return "N"
    return "C" if w in COMMON else "F"


def around(line: str, start: int, end: int) -> tuple[list[str], str, str, str]:
    """(last words before, word after, character before, character after), in lower case."""
    before = re.findall(r"[^\W\d_]+", line[max(0, start - 30) : start].lower())[-3:]
    after = re.match(r"[\s,;:.)\]>]*([^\W\d_]*)", line[end : end + 20].lower()).group(1)
    return before, after, line[start - 1 : start], line[end : end + 1]


#: Features of numbers of more than six groups; fitted after the others.
MANY = "many groups:"


def number_features(kind: str, line: str, start: int, end: int) -> list[str]:
    value = line[start:end]
    digits = re.sub(r"\D", "", value)
    groups = "-".join(str(len(g)) for g in re.findall(r"\d+", value))
    before, after, left, right = around(line, start, end)
    near = set(before[-2:])
    f = [f"{kind}", f"{kind}:groups={groups}", f"{kind}:n={min(len(digits), 14)}"]
    if groups.count("-") > 5:
        lead = "plus" if value[0] == "+" else "exit" if digits[:2] == "00" else "plain"
        f += [f"{MANY}{kind}:{lead}"] + [f"{MANY}{kind}:singles"] * (2 * groups.split("-").count("1") >= groups.count("-"))
    if value[0] == "+":
        f.append(f"{kind}:plus")
    if value[0] == "(":
        f.append(f"{kind}:bracket")
    if re.fullmatch(r"(?:\+?1[ .-]?)?\(?[2-9]\d\d\)?[ .-]?[2-9]\d\d[ .-]?\d{4}", value):
        f.append(f"{kind}:ten")
    if re.fullmatch(r"[2-9]\d\d[-.]\d{4}", value):
        f.append(f"{kind}:seven")
    if re.fullmatch(r"\+\d{1,3}(?:[\s.-]?\(?\d+\)?)+", value) and 9 <= len(digits) <= 14:
        f.append(f"{kind}:abroad")
    if re.fullmatch(r"\(?0\d{2,4}\)?[ -]?\d{3,4}[ -]?\d{3,4}", value) and 10 <= len(digits) <= 11:
        f.append(f"{kind}:trunk")
    if re.search(r"(?:19|20)\d\d[-/. ]\d\d?[-/. ]\d\d?|\d\d?[-/.]\d\d?[-/.](?:19|20)\d\d", value) or re.search(r"(?:19|20)\d\d$", value):
        f.append(f"{kind}:date")
    if re.match(r"[:/]\d", line[end : end + 2]) or (left in ":/" and left):
        f.append(f"{kind}:clock")
    if left and (left.isalnum() or left in "#$€£-_.,@"):
        f.append(f"{kind}:glued")
    if right and (right.isalnum() or right in "@_%" or re.match(r"[-.,][\dA-Z]", line[end : end + 2])):
        f.append(f"{kind}:goes on")
    if near & PHONE_CUE:
        f.append(f"{kind}:phone cue")
    if near & ID_CUE:
        f.append(f"{kind}:id cue")
    if near & STRONG_ID_CUE or set(re.findall(r"[^\W\d_]+", line[end : end + 24].lower())[:3]) & STRONG_ID_CUE:
        f.append(f"{kind}:strong id cue")
    if before and before[-1] in CODE_CUE and not near & STRONG_ID_CUE:
        f.append(f"{kind}:code cue")
    if after in ("units", "days", "hours", "per", "pallets", "bags", "crates", "drums", "litres", "metres", "pages", "reels", "tonnes", "barrels"):
        f.append(f"{kind}:unit")
    return f


def code_shape(value: str) -> str:
    """Digits as 9, letters as A."""
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", value))


def name_features(line: str, words: list[re.Match], order: str) -> list[str]:
    kinds = "".join(word_kind(w.group()) for w in words)
    start, end = words[0].start(), words[-1].end()
    family = words[0].group() if order.startswith("F") else words[-1].group()
    before, after, left, right = around(line, start, end)
    f = ["name", f"name:{order}", f"name:{order}:{kinds}"]
    listed = ("G" in kinds or "N" in kinds or "I" in kinds) and not (order == "GMF" and kinds[0] == "F")
    common = kinds.count("C") > 0
    f.append("name:family=" + word_kind(family))
    if len(fold(family)) < 4:
        f.append("name:short")
    if family.isupper():
        f.append("name:upper")
    last = before[-1] if before and re.search(r"[^\W\d_][\s.,:]*$", line[max(0, start - 12) : start]) else ""
    if last in TITLE:
        f.append("name:title")
    elif last in ROLE_BEFORE:
        f.append("name:role before")
    if after in ROLE_AFTER and right == " ":
        f.append("name:role after")
    beside = re.match(r"\s?(?:<|\[mailto:|\(|/\s|\|\s)", line[end : end + 9])
    if beside:
        f.append("name:beside")
        local = re.match(r"\s?(?:<|\[mailto:|\()([\w.+-]+)@", line[end : end + 60])
        if local and len(fold(family)) > 3 and fold(family) in local.group(1).lower():
            f.append("name:address")
        if local and not listed and sum(1 for w in words if len(fold(w.group())) > 2 and fold(w.group()) in local.group(1).lower()) > 1:
            f.append("name:whole address")
    if not line[:start].strip(" >|*-\t") and not line[end:].strip(" \r"):
        f.append("name:alone")
    following = CAPITAL.match(line, end + 1) if right == " " else None
    if following and word_kind(following.group()) == "C" and fold(following.group()) not in ROLE_AFTER:
        f.append("name:firm after")
    elif following and word_kind(following.group()) == "F":
        f.append("name:capital after")
    if left and left in "-/–" and line[start - 2 : start - 1].isalnum():
        f.append("name:glued")
    elif left and left not in " \t>|(\"'“‘[<:\n.,;—–/-*":
        f.append("name:glued")
    if re.match(r"['’]?[\w@]", line[end : end + 1]) and not line[end - 1 : end] == ".":
        f.append("name:goes on")
    if not listed or common:  # what stands around has to speak for it
        if re.match(r"\s(?:wrote|writes|said|says|schrieb|escribió|a écrit|called|signed|asked)\b", line[end : end + 12]):
            f.append("name:speaks")
        if HEADER.search(line, 0, start) and not line[end:].strip(" \r<[(,;") or (beside and HEADER.search(line, 0, start)):
            f.append("name:header")
        side = "common" if common else "unlisted"
        f += [f"{side}:{x[5:]}" for x in f[3:] if not x.startswith("name:family")]
        f.append(side)
        if not common and all(w.group()[1:].islower() for w in words):
            f.append("unlisted:title case")
    return f


HEADER = re.compile(r"(?:^|[>|\s])(?:from|to|cc|von|an|de|sender|contact|attn)\s*:\s*$", re.I)
#: Particles between given and family name.
PARTICLES = re.compile(r" (?:(?:van|von|de|der|den|di|da|del|la|le|ter|ten|bin|al|zu|zur|dos) ){1,3}")


def candidates(line: str) -> list[tuple[int, int, str, tuple[str, ...]]]:
    """(start, end, kind, features) of the segments of a line that may be personal values."""
    out = []
    if "@" in line or " at " in line or " AT " in line or "at]" in line or "at)" in line or "AT" in line:
        for m in EMAIL.finditer(line):
            value = m.group()
            f = ["email", "email:plain" if "@" in value and " " not in value else "email:words"]
            if not re.search(rf"@[\w.-]+\.[A-Za-z]{{2,}}$|{DOT}[A-Za-z]{{2,}}$", value):
                f.append("email:no domain")
            if "@" not in value:
                if not re.search(r"[\[({<]|\bdot\b|\bDOT\b", value):
                    f.append("email:only at")
                if "." in value or "_" in value:
                    f.append("email:dotted")
            out.append((m.start(), m.end(), "email", tuple(f)))
    if DIGIT.search(line):
        for m in DIGITS.finditer(line):
            if len(m.group()) < 7:
                continue
            groups = list(GROUP.finditer(line, m.start(), m.end()))
            for i, a in enumerate(groups):
                n = 0
                for b in groups[i : i + 15]:  # 15 digits are in at most 15 groups
                    n += sum(map(str.isdigit, b.group()))
                    if n > 15:
                        break
                    if n < 7:
                        continue
                    start, end = a.start(), b.end()
                    if line[start] == "(" and line.count("(", start, end) > line.count(")", start, end):
                        start += 1  # a bracket around the number
                    part = ("part",) if a is not groups[0] or b is not groups[-1] else ()
                    out.append((start, end, "phone", (*number_features("phone", line, start, end), *(f"phone:{x}" for x in part))))
                    if NINE.fullmatch(line, start, end):
                        out.append((start, end, "id_number", (*number_features("id", line, start, end), *(f"id:{x}" for x in part))))
        for m in CODED.finditer(line):
            if sum(map(str.isdigit, m.group())) >= 5:
                f = number_features("code", line, m.start(), m.end())
                out.append((m.start(), m.end(), "id_number", (*f, f"code:shape={code_shape(m.group())}")))
        for m in STREET.finditer(line):
            value = m.group()
            f = ["street", "street:" + ("box" if "Box" in value else "first" if value[0].isdigit() else "last")]
            if re.search(r"\d(?:st|nd|rd|th)\b", value):
                f.append("street:ordinal")
            before = around(line, m.start(), m.end())[0]
            if before and before[-1] in CODE_CUE:
                f.append("street:code cue")
            out.append((m.start(), m.end(), "street", tuple(f)))
    words = list(CAPITAL.finditer(line))
    for i in range(len(words) - 1):
        a, b = words[i], words[i + 1]
        gap = line[a.end() : b.start()]
        if len(gap) > 20:
            continue
        ka, kb = word_kind(a.group()), word_kind(b.group())
        c = words[i + 2] if i + 2 < len(words) and line[b.end() : words[i + 2].start()] == " " else None
        kc = word_kind(c.group()) if c else ""
        if gap == " ":
            if a.group().endswith(".") and len(fold(a.group())) > 1:
                continue  # a sentence or title ends here
            if kb != "I":
                out.append(_name(line, [a, b], "FG" if ka in "FC" and kb in "GN" else "GF"))
            if c and kc != "I" and (kb == "I" or (ka in "FGN" and kb in "FGN" and not b.group().endswith("."))) and ka != "I":
                out.append(_name(line, [a, b, c], "GMF"))
        elif gap == ", ":
            if kb in "GNI" or not (ka == "C" and kb == "C"):
                if c and kc == "I" and kb != "I":
                    out.append(_name(line, [a, b, c], "F,GM"))
                out.append(_name(line, [a, b], "F,G"))
        elif word_kind(b.group()) != "I" and PARTICLES.fullmatch(gap):
            out.append(_name(line, [a, b], "GpF"))
    return out


DIGIT = re.compile(r"\d")


def _name(line: str, words: list[re.Match], order: str) -> tuple[int, int, str, tuple[str, ...]]:
    last = words[-1]
    end = last.end()
    # the full stop belongs to an initial, not to a family name that ends the sentence
    if last.group().endswith(".") and len(last.group()) > 2:
        end -= 1
    return words[0].start(), end, "name", tuple(name_features(line, words, order))


def transition(line: str, before: tuple[int, int, str], after: tuple[int, int, str]) -> str:
    """Feature of a segment right behind another: both kinds and what is between them."""
    return f"{before[2]}>{after[2]}:{line[before[1] : after[0]]}"


class Field:
    """The random field: weights of features and transitions; a segmentation's score is their sum, text outside scores nothing."""

    def __init__(self, weights: dict[str, float]):
        self.w = weights

    def score(self, features: tuple[str, ...]) -> float:
        return sum(self.w.get(f, 0.0) for f in features)

    def behind(self, line: str, found: list[tuple], ends: list[int], i: int) -> Iterator[tuple[int, float]]:
        """(index, transition weight) of the segments that segment i, in order of ends, stands right behind."""
        start = found[i][0]
        for j in range(bisect.bisect_left(ends, start - BESIDE), bisect.bisect_right(ends, start)):
            yield j, self.w.get(transition(line, found[j], found[i]), 0.0)

    def best(self, line: str) -> list[tuple[int, int, str]]:
        """The segmentation of highest score."""
        found = [(s, e, k, x) for s, e, k, f in candidates(line) if (x := self.score(f)) > -MOST_TRANSITION]
        if not found:
            return []
        found.sort(key=lambda c: c[1])
        ends = [c[1] for c in found]
        own: list[tuple[float, int]] = []  # of each segment as the last one: score, and the one before (-1: none)
        top: list[tuple[float, int]] = [(0.0, -1)]  # of the first i segments: the best last one
        for i, (start, _, _, x) in enumerate(found):
            score, before = top[bisect.bisect_left(ends, start - BESIDE, 0, i)]
            for j, t in self.behind(line, found, ends, i):
                if own[j][0] + t > score:
                    score, before = own[j][0] + t, j
            own.append((score + x, before))
            top.append(max(top[-1], (score + x, i), key=lambda c: c[0]))
        out, i = [], top[-1][1]
        while i >= 0:
            out.append(found[i][:3])
            i = own[i][1]
        return out[::-1]

    def expectations(self, line: str, found: list[tuple[int, int, str, tuple[str, ...]]]) -> tuple[list[float], dict[tuple[int, int], float]]:
        """Probability of each candidate, and of each pair of one right behind another, under the field.

        Forward sums run over the ends, backward sums over the starts; a pair with a transition differs from one without by its factor."""
        order = sorted(range(len(found)), key=lambda i: found[i][1])
        rows = [found[i] for i in order]
        ends, n = [c[1] for c in rows], len(rows)
        x = [math.exp(min(30.0, self.score(c[3]))) for c in rows]
        pairs = {(j, i): math.exp(self.w.get(transition(line, rows[j], rows[i]), 0.0)) for i in range(n) for j in range(bisect.bisect_left(ends, rows[i][0] - BESIDE), bisect.bisect_right(ends, rows[i][0], 0, i))}
        before, after = defaultdict(list), defaultdict(list)
        for (j, i), w in pairs.items():
            before[i].append((j, w))
            after[j].append((i, w))
        forward, sums = [], [1.0]
        for i in range(n):
            forward.append(x[i] * (sums[bisect.bisect_right(ends, rows[i][0], 0, i)] + sum(forward[j] * (w - 1) for j, w in before[i])))
            sums.append(sums[-1] + forward[-1])
        backward = [0.0] * n
        by_start = sorted(range(n), key=lambda i: -rows[i][0])
        starts, tails = [], [1.0]  # negated starts in ascending order
        for i in by_start:
            backward[i] = tails[bisect.bisect_right(starts, -rows[i][1])] + sum(x[k] * backward[k] * (w - 1) for k, w in after[i])
            starts.append(-rows[i][0])
            tails.append(tails[-1] + x[i] * backward[i])
        out = [0.0] * n
        for a, i in enumerate(order):
            out[i] = forward[a] * backward[a] / sums[-1]
        return out, {(order[j], order[i]): forward[j] * w * x[i] * backward[i] / sums[-1] for (j, i), w in pairs.items()}


#: Characters between a segment and one right behind it; what a transition may weigh at most.
BESIDE, MOST_TRANSITION = 3, 3.0


def training_lines(n: int = TRAIN_LINES, seed: int = 20260101, part: tuple[int, int] | None = None, own: bool = True) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Labelled lines from frames and invented words; {x} slots are personal, [x] slots are look-alikes.

    {other} is a name whose given name is in no list: in frames that tell it by what stands around it. `part` = (i, m) takes
    every m-th frame, or (own false) all but those."""
    rng = random.Random(seed)
    syllable = lambda: rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") + rng.choice(["", "l", "n", "r", "s", "k"])
    family = lambda: "".join(syllable() for _ in range(rng.choice((2, 3)))).capitalize() + rng.choice(("berg", "son", "er", "ov", "ley", "ton", "man", "dahl"))
    digits = lambda m: "".join(rng.choice("123456789") if c == "9" else rng.choice("23456789") if c == "2" else c for c in m)
    givens, nicks = sorted(GIVEN), sorted(NICKNAMES)

    def name() -> str:
        g, f = rng.choice(givens).capitalize(), family()
        i, m = g[0], rng.choice("ABCDEFGHJKLMNPRSTW")
        return rng.choice((f"{g} {f}", f"{g} {f}", f"{rng.choice(nicks).capitalize()} {f}", f"{i}. {f}", f"{i} {f}", f"{f}, {g}", f"{f}, {i}.", f"{g} {m}. {f}", f"{f}, {g} {m}", f"{f} {g}", f"{f}, {rng.choice(nicks).capitalize()}", f"{g} {rng.choice(givens).capitalize()} {f}"))

    def other() -> str:
        g, f = "".join(syllable() for _ in range(rng.choice((2, 2, 3)))).capitalize() + rng.choice(("", "", "a", "o", "w", "ka", "in")), family()
        m = rng.choice("ABCDEFGHJKLMNPRSTW")
        return rng.choice((f"{g} {f}",) * 5 + (f"{g} {m}. {f}", f"{g} {rng.choice(givens).capitalize()} {f}", f"{g} {family()[:4]} {f}", f"{g} van der {f}", f"{g} de {f}"))

    def mail() -> str:
        a, d = f"{rng.choice(givens)}{rng.choice('._')}{family().lower()}", f"{family().lower()}"
        return rng.choice((f"{a}@{d}.example",) * 4 + (f"{a}@mail.{d}.test", f"{a} at {d} dot example", f"{a} [at] {d}.example", f"{a}(at){d}.test", f"{a} (at) {d} (dot) com"))

    phone = lambda: digits(rng.choice(("(299) 299-9999", "(299)299-9999", "299-299-9999", "299.299.9999", "2992999999", "1-299-299-9999", "+1 299 299 9999", "299-9999", "+44 (0)20 7999 9999", "+44 7999 999999", "07999 999999", "020 7999 9999", "+49 30 99999 999", "+33 1 99 99 99 99")))
    ident = lambda: digits(rng.choice(("999-99-9999", "999 99 9999", "999999999", "X9999999", "D999-9999-999", "QQ999999D", "QQ 99 99 99 C", "E-99999", "99-9999999", "00-9999999")))
    street = lambda: rng.choice((f"{rng.randint(2, 980)} {family()} {rng.choice('Street Road Lane Court Place Blvd St Ave. Drive'.split())}", f"{rng.randint(2, 90)}-{rng.randint(91, 120)} {family()} Place", f"{rng.randint(2, 980)} N. {family()} Blvd", f"{rng.randint(2, 98)} rue {family()}", f"{family()}strasse {rng.randint(1, 99)}a", f"{family()}weg {rng.randint(1, 99)}", f"P.O. Box {rng.randint(2, 980)}"))
    org = lambda: f"{family()} {rng.choice('Freight Marine Power Grid Rail Gas'.split())} {rng.choice('Services Company Partners Logistics Brokers'.split())}"
    place = lambda: f"{family()} {rng.choice('Terminal Junction Ridge Quay Loop Basin Works Station Board Class Hall Star'.split())}"
    code = lambda: digits(rng.choice(("PO 9999-99-99999 covers lot 2001-9999", "Invoice 99-9999-99 and meter M-9999 are settled", "Build 10.9.99.9 is installed", "The rate is 999.999 per unit @ 99 days", "Ticket #29999999999 is closed", "Use part 999-99-A, not 999-99-B", "quoted 999,999.00 for it", "Order 9999999 shipped", "Item 299-9999-99 is out", "Sent: 2001-09-12 09:99", "Date: 01/04/1999 11:10 AM", "lot 2999-9999")))
    slots = {"other": other, "name": name, "email": mail, "phone": phone, "id_number": ident, "street": street}
    others = {"org": org, "place": place, "code": code, "given": lambda: rng.choice(givens).capitalize(), "family": family, "UP": lambda: rng.choice((family().upper(), rng.choice("SITE DATA TARIFF METER PRICE CREW AUDIT VALVE".split()))), "n": lambda: str(rng.randint(2, 400)), "year": lambda: str(rng.randint(1997, 2024)), "day": lambda: rng.choice("Monday Tuesday Friday January May March".split())}
    frames = """{name} wrote:|--- {name} <{email}> wrote:|From: {name} <{email}>|To: {name} [mailto:{email}]|To: {name}|{name} said:|Ask {name} or somebody in the lab.|Interview with {name} is set.|The badge of {name} has expired.|cc {name} next time.|Please check with {name} first.|{name} will sign for us.|I spoke to {name} about it.|{name} wants a copy. The order is late.|Dr. {name} called.|{name} / Dispatch Clerk, [org] / T {phone} / {street} / e: {email}|{name}|{name}|Tel {phone}|Phone: {phone} ext. 31|T {phone}|{phone}|Call {phone} if the gate is shut.|Ring {phone}, not the switchboard.|She left {phone} as a callback.|The new line is {phone} x214.|{phone} is the number for the night desk.|Text me ({phone}) when done.|Fax it to {phone} please.|Mobile {phone} after six.|SSN {id_number} is on the form.|ID {id_number} belongs to the new driver.|Her passport no. is {id_number}.|The licence reads {id_number}.|Staff number {id_number} needs a new badge.|Use {id_number} as the tax reference.|National insurance {id_number} was rejected by payroll.|audit id {id_number}|{street}, Suite 12|{street}, [family] 40213|He lives at {street} now.|Bill to: {street}|Meet me outside {street}.|We moved to {street} in May.|Deliver at {street}, second floor.|{email}|e: {email}|Contact: {email}|Her private address is {email}.|({email} bounced yesterday)|Write to {email}; the old one is closed.|I use {email} from home.|mailto:{email}|[code].|[org] [code].|[code]. [code].|Room [n] [place] is booked.|[place] - crew roster week [n]|RE: [place]: rail slots no. [n] call {phone}|Hello [given]|Hi [given],|Dear [given],|Good morning [given],|On [day] the crew wrote [n] tags and left.|[org]|Metering Lead, [org]|Port Agent | [family]|To: [org]|[given] -|Thanks, [given]|Ask [given] about it.|Please ask [given] whether [n] of the [n] bags are shared.|From: north yard, pallet [n]|To: dock nine, [n] crates|Subject: [place] outage plan|The [family] invoice came to 43 and 220 for the sensor.|We owe [place] an answer. See [place] for the rest.|Look at Monday, May [n], 2001 3:25 AM|{name} wrote on Thursday, January [n], 2001 6:51 AM:|[place] {name} {street} {phone}|Don't meet at noon. Send it to [given].|Use Best [given]|No [given] Reply|Call [given] now, [n] [given]s wait.|[place] Q3 [year]|FW: [place] data request Q1 [year]|ATENÇÃO: A REUNIÃO NÃO MUDA; SÃO [n] CAIXAS.|ATENÇÃO: A POSIÇÃO NÃO MUDA|On Thursday, January 6, 2000 8:44 PM, {name} wrote:|Mobile {phone} [n] reels are late.|[code]. {phone} is the number.|Deliver at {street} [n] bags were left.|Le [n]/07/2002, {name} <{email}> a écrit :|Am 5. Juli [year] schrieb {name}:|----- Message from {name} on [year]-11-21 04:06 -----|{name} / Port Agent / {street} / {email}|{phone} [n] drums|[org] / Yard Supervisor on duty|[code] T {phone}|Good morning [given], {name} called.|{name} {email}|Call {phone} or {phone}.|Use part 555-[n]-A, not 555-[n]-B. [family] is here.|No. 12-A. [family] [family] said no.""".split("|")  # noqa: E501
    frames += """{other} wrote:|--- {other} wrote:|Dr. {other} called.|Mr. {other} will not come.|Ms. {other} has the key|Prof. {other} signed it.|{other} said:|From: {other}|To: {other}|Cc: {other}|From: {other} <{email}>|To: {other} [mailto:{email}]|{other} <{email}> wrote:|On Thursday, January 6, 2000 8:44 PM, {other} wrote:|Am 5. Juli [year] schrieb {other}:|{other} schrieb am Montag:|Le [n]/07/2002, {other} <{email}> a écrit :|From: {other} (Port Agent)|Contact: {other} <{email}>|Sir {other} is here.|Herr {other} hat gefragt.|Mrs {other}, please call.|{other} says no.|{other} writes:|Miss {other} signed first|> {other} wrote:|Attn: {other}|{other} ({email})""".split("|")
    frames += """[family] [family] is open again|RE: [UP] [UP], [UP] QUAY WEEK [n]|[UP] [UP] [UP] REV [n]|FW: [UP] [UP] WEEK [n]|[UP] [UP]|Bitte schicken Sie die [family] [family] im [family].|Die [family] im [family] wurde am Montag überprüft.|Im [family] stehen [n] Kisten, eine [family] gehört nicht dazu. Für [family] ist [family].|[family] [family] storage rates ([family] [family]) no. [n]|rates for [family] [family]|[family] [family]|The [family] [family] meeting is off|[place] [family] request|Subject: [family] [family]|To: [family] Freight Desk|From: [place]|To: [org]|[family]. [family] is late.|Sent: [day] [family]|[family] [family] Company|[UP] DATA REQUEST|[UP] [UP]: [UP] PLANT|Könnten Sie [day] klären, ob die [family] fehlt?|Read Me First|Good Morning|Copy That|[org] said no|[org] <{email}>""".split("|")
    frames = [f.strip() for f in frames if f.strip()]
    if part is not None:
        frames = [f for k, f in enumerate(frames) if (k % part[1] == part[0]) == own]
    for _ in range(n):
        frame, line, gold = rng.choice(frames), "", []
        for piece in re.split(r"(\{\w+\}|\[(?:org|place|code|given|family|n|year|day|UP)\])", frame):
            if piece[:1] == "{":
                value = slots[piece[1:-1]]()
                gold.append((len(line), len(line) + len(value), "name" if piece == "{other}" else piece[1:-1]))
                line += value
            else:
                line += others[piece[1:-1]]() if piece[:1] == "[" and piece[1:-1] in others else piece
        yield line, gold


def number_rows(n: int, seed: int = 20260102) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Labelled lines of counted or listed numbers, some with a phone number of many groups or one behind the row."""
    rng = random.Random(seed)
    digits = lambda m: "".join(rng.choice("123456789") if c == "9" else rng.choice("23456789") if c == "2" else c for c in m)
    for _ in range(n):
        many, first, top = rng.randint(4, 24), rng.randint(0, 9), rng.choice((9, 9, 40, 400))
        row = " ".join(str(first + i if top == 40 else rng.randint(1, top)) for i in range(many))
        abroad, local = digits(rng.choice(("+33 (0)9 99 99 99 99", "00 33 9 99 99 99 99"))), digits(rng.choice(("299-299-9999", "(299) 299-9999", "299.299.9999")))
        line, value = rng.choice(((row, ""), (row, ""), (f"{row} {local}", local), (f"Call {abroad}", abroad), (abroad, abroad), (f"{local} {abroad}", abroad)))
        gold = [(len(line) - len(value), len(line), "phone")] if value else []
        yield line, [(0, len(local), "phone"), *gold] if line == f"{local} {abroad}" else gold


@functools.lru_cache(2)
def fitted(n: int = TRAIN_LINES, epochs: int = EPOCHS) -> Field:
    """The field fitted to the training lines."""
    field = Field(defaultdict(float))
    _fit(field, training_lines(n), epochs, False)
    _fit(field, number_rows(n // 10), epochs, True)
    return Field(dict(field.w))


def _fit(field: Field, lines: Iterator[tuple[str, list[tuple[int, int, str]]]], epochs: int, many: bool) -> None:
    """Fit the weights of numbers of more than six groups with the others held, or of the others without such numbers."""
    data = []
    for line, gold in lines:
        found = [c for c in candidates(line) if many or not any(f.startswith(MANY) for f in c[3])]
        wanted = {(s, e, k) for s, e, k in gold}
        if found:
            data.append((line, found, [1.0 if c[:3] in wanted else 0.0 for c in found]))
    rng = random.Random(1)
    for epoch in range(epochs):
        rng.shuffle(data)
        rate = RATE / (1 + epoch)
        for line, found, wanted in data:
            have, pairs = field.expectations(line, found)
            for (_, _, _, features), want, p in zip(found, wanted, have):
                step = rate * (want - p)
                if abs(step) > 1e-4:
                    for f in features:
                        if many and not f.startswith(MANY):
                            continue
                        field.w[f] += step - rate * DECAY * field.w[f]
            if not many:
                for (j, i), p in pairs.items():
                    step = rate * (wanted[j] * wanted[i] - p)
                    if abs(step) > 1e-4:
                        f = transition(line, found[j], found[i])
                        field.w[f] = max(-MOST_TRANSITION, min(MOST_TRANSITION, field.w[f] + step - rate * DECAY * field.w[f]))


def values_of(field: Field, text: str, memo: dict[str, list[tuple[int, int, str]]]) -> dict[tuple[str, str], None]:
    """(kind, value) of a text, in order, once each."""
    out: dict[tuple[str, str], None] = {}
    for line in text.split("\n"):
        if len(line) < 4:
            continue
        spans = memo.get(line)
        if spans is None:
            spans = field.best(line)
            if len(memo) > 100_000:
                memo.clear()
            memo[line] = spans
        for s, e, k in spans:
            out[k, line[s:e]] = None
    return out


def redacted(field: Field, text: str) -> str:
    lines = []
    for line in text.split("\n"):
        for s, e, k in reversed(field.best(line)):
            line = line[:s] + PLACEHOLDER[k] + line[e:]
        lines.append(line)
    return "\n".join(lines)


def find(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, kind, value: each personal value of a field once."""
    weights = df.sparkSession.sparkContext.broadcast(fitted().w)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, memo = Field(weights.value), {}
        for b in it:
            rows = []
            for i, name in enumerate(fields):
                for k, text in zip(b.column(0).to_pylist(), b.column(i + 1).to_pylist()):
                    if text:
                        rows += [(k, name, *v) for v in values_of(field, text, memo)]
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema[0].type), *(pa.array(c, pa.string()) for c in columns[1:])], ["k", "field", "kind", "value"])

    rows = spread(df.select(F.col(key).alias("k"), *[F.col(f"`{f}`").cast("string").alias(f"f{i}") for i, f in enumerate(fields)]))
    return rows.mapInArrow(batches, f"k {rows.schema[0].dataType.simpleString()}, field string, kind string, value string").withColumnRenamed("k", key)


def redact(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key and the fields with typed placeholders in place of the values."""
    weights = df.sparkSession.sparkContext.broadcast(fitted().w)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(weights.value)
        for b in it:
            done = [pa.array([t if not t else redacted(field, t) for t in c.to_pylist()], pa.string()) for c in b.columns[1:]]
            yield pa.RecordBatch.from_arrays([b.column(0), *done], ["k", *[f"f{i}" for i in range(len(fields))]])

    rows = spread(df.select(F.col(key).alias("k"), *[F.col(f"`{f}`").cast("string").alias(f"f{i}") for i, f in enumerate(fields)]))
    schema = ", ".join([f"k {rows.schema[0].dataType.simpleString()}", *[f"f{i} string" for i in range(len(fields))]])
    return rows.mapInArrow(batches, schema).toDF(key, *fields)
