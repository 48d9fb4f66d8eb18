"""How people write school names: parsing a spelling into owner, club word, base and suffix, and comparing two.

Used by the name problems (1, 3, 4, 5). A spelling is folded (plain characters, one form of each ideograph, kana
readings back to ideographs, particles and doubled characters removed) and split; two spellings are compared by their
suffixes and an edit distance of one on the base. Everything here works on single strings and is called from
vectorised functions over distinct names only.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

# Kun readings of ideographs that occur in place-like names.
READINGS = {
    "あお": "青", "あか": "赤", "あき": "秋", "あさ": "朝", "あみ": "網", "あゆ": "鮎", "あら": "荒", "いけ": "池", "いし": "石", "いそ": "磯",
    "いち": "市", "いと": "糸", "いな": "稲", "いぬ": "犬", "いま": "今", "いわ": "岩", "うし": "牛", "うた": "歌", "うち": "内", "うま": "馬",
    "うみ": "海", "うめ": "梅", "うら": "浦", "うり": "瓜", "えだ": "枝", "おき": "沖", "おく": "奥", "おと": "音", "おび": "帯", "おり": "折",
    "かい": "貝", "かき": "柿", "かげ": "影", "かさ": "笠", "かし": "樫", "かぜ": "風", "かね": "鐘", "かば": "蒲", "かま": "鎌", "かみ": "神",
    "かめ": "亀", "かや": "茅", "から": "唐", "かわ": "川", "きく": "菊", "きし": "岸", "きた": "北", "きぬ": "衣", "きよ": "清", "きり": "桐",
    "くさ": "草", "くし": "櫛", "くす": "楠", "くち": "口", "くに": "国", "くぼ": "窪", "くま": "熊", "くも": "雲", "くら": "倉", "くろ": "黒",
    "くわ": "桑", "こし": "越", "こと": "琴", "こま": "駒", "さか": "坂", "さき": "崎", "さぎ": "鷺", "ささ": "笹", "さと": "里", "さる": "猿", "さわ": "沢",
    "しい": "椎", "しお": "塩", "しか": "鹿", "しき": "敷", "しの": "篠", "しば": "芝", "しま": "島", "しも": "霜", "しろ": "城", "すぎ": "杉",
    "すげ": "菅", "すず": "鈴", "すな": "砂", "すみ": "墨", "せき": "関", "せり": "芹", "その": "園", "そら": "空", "たか": "高", "たき": "滝",
    "たけ": "竹", "たな": "棚", "たに": "谷", "たね": "種", "たま": "玉", "たる": "樽", "ちか": "近", "つき": "月", "つじ": "辻", "つた": "蔦",
    "つち": "土", "つな": "綱", "つの": "角", "つぼ": "坪", "つゆ": "露", "つる": "鶴", "てら": "寺", "とき": "時", "とも": "友", "とよ": "豊",
    "とら": "虎", "とり": "鳥", "なか": "中", "なし": "梨", "なだ": "灘", "なつ": "夏", "なべ": "鍋", "なみ": "波", "なら": "楢", "なり": "成",
    "なわ": "縄", "にし": "西", "ぬの": "布", "はぎ": "萩", "はし": "橋", "はす": "蓮", "はた": "畑", "はな": "花", "はま": "浜", "はら": "原",
    "はる": "春", "ひがし": "東", "ひさ": "久", "ひし": "菱", "ひめ": "姫", "ひら": "平", "ひろ": "広", "ふか": "深", "ふく": "福", "ふじ": "藤",
    "ふね": "船", "ふる": "古", "ほし": "星", "ほそ": "細", "ほり": "堀", "まき": "牧", "まち": "町", "まつ": "松", "まど": "窓", "まる": "丸",
    "みち": "道", "みなみ": "南", "みぞ": "溝", "みね": "峰", "みの": "蓑", "みや": "宮", "むぎ": "麦", "むら": "村", "むろ": "室", "もり": "森",
    "もん": "門", "やま": "山", "ゆき": "雪", "ゆみ": "弓", "よこ": "横", "よし": "吉", "よね": "米", "わか": "若", "わし": "鷲", "わた": "綿",
}
# Older and variant forms of ideographs and the usual one of each.
USUAL = dict(
    zip(
        "枩靏桒付埼薗澤舩楳邨阪廣瀧礒豐橿樟蔵龜奧嶋景芲稻筱媛峯橫國絲谿鐮艸鍾畠哥沙巌槗杜河濱鹽穐繩學髙﨑廳關實總澁邊齋齊黑鷄壽應會",
        "松鶴桑附崎園沢船梅村坂広滝磯豊樫楠倉亀奥島影花稲篠姫峰横国糸谷鎌草鐘畑歌砂岩橋森川浜塩秋縄学高崎庁関実総渋辺斎斉黒鶏寿応会",
        strict=True,
    )
)
# Suffixes of school names, in full and as people shorten them.
SUFFIXES = {
    "女子学園": "女子学園", "女学園": "女子学園", "女子学院": "女子学園", "女子": "女子学園", "科学技術": "科学技術", "科技": "科学技術", "科学技": "科学技術", "科技術": "科学技術",
    "大学附属": "大附属", "大附属": "大附属", "大附": "大附属", "附属": "大附属", "学園": "学園", "学院": "学院", "大高": "大高", "大学": "大高", "義塾": "義塾",
    "商業": "商業", "工業": "工業", "工科": "工業", "農業": "農業", "実業": "実業", "総合": "総合", "国際": "国際", "インターナショナル": "国際", "芸術": "芸術",
    "第一": "第一", "第二": "第二", "第三": "第三", "第四": "第四", "第五": "第五", "館": "館", "東": "東", "西": "西", "南": "南", "北": "北",
}
SHORT = {
    "学": "学園 学院", "園": "学園", "院": "学院", "商": "商業", "工": "工業", "農": "農業", "実": "実業", "総": "総合", "国": "国際", "塾": "義塾", "芸": "芸術",
    "技": "科学技術", "大": "大高 大附属", "一": "第一", "二": "第二", "三": "第三", "四": "第四", "五": "第五", "女": "女子学園", "科": "科学技術",
}
KANA_WORDS = {"がくえん": "学園", "がくいん": "学院", "かん": "館", "ぎじゅく": "義塾", "だい": "第"}
CLUB_ENDS = {"FCユース": "FCユース", "SCユース": "SCユース", "SCY": "SCユース", "FCY": "FCユース", "FC": "FC FCユース", "SC": "SC SCユース", "ユース": "FCユース SCユース"}
READING = re.compile("|".join(sorted(READINGS, key=len, reverse=True)))
STARTS = {x for x, full in SUFFIXES.items() if len(x) == 1 and x == full}
ENDS = STARTS | set(SHORT)
MOVABLE = sorted((s for s in SUFFIXES if SUFFIXES[s] == s), key=len, reverse=True)
BY_LENGTH = sorted(SUFFIXES, key=len, reverse=True)


class Form(NamedTuple):
    """One reading of a spelling. suffix: the possible full suffixes; high: it ends in 高 beyond the suffix."""

    club: str
    base: str
    suffix: frozenset[str]
    high: bool


def fold(name: str) -> str:
    """Plain characters, no remarks, squads, owners or 高等学校."""
    s = unicodedata.normalize("NFKC", name)
    s = re.sub(r"\([^()]*\)|サッカー部$", "", s)
    s = re.sub(r"[\s​-‏⁠-⁤﻿]+", " ", s).strip()
    s = re.sub(r"\s+(?:[A-J]|\d(?:st|nd|rd|th)|Ⅱ|II|III|セカンド|サード)$", "", s)
    s = re.sub(r"[\s・\-]*U[\-‐]?\d\d$", "", s).replace(" ", "")
    s = re.sub(r"^(?:東京都立|東京都|都立|私立|国立|市立|県立|区立|都・|私・|国・|都(?=..))", "", s)
    s = re.sub(r"(?:高等学校|高等学|高等部|高校)$", "高", s).replace("高等学校", "高")
    return s


def mechanical(name: str | None) -> str | None:
    """A name as printed, cleaned as the normalised columns are: no width variants, remarks, spaces, owner or 高校."""
    if not name:
        return None
    s = unicodedata.normalize("NFKC", name)
    s = re.sub(r"\([^()]*\)|サッカー部$", "", s)
    s = re.sub(r"[\s\u200b-\u200f\u2060-\u2064\ufeff\xad]+", "", s)
    s = re.sub(r"^(?:東京都立|都立|私立|国立|都・|私・|国・|都(?![市・])(?=..))", "", s)
    return re.sub(r"(?<=.)(?:高等学校|高校)$", "", s) or None


def _clean(base: str) -> str:
    """Readings to ideographs, particles out, doubled characters once."""
    base = READING.sub(lambda m: READINGS[m.group()], base)
    base = re.sub("[がヶケのノつッ之ケ]", "", base)
    return re.sub(r"(.)\1", r"\1", base)


@lru_cache(maxsize=200_000)
def forms(name: str) -> tuple[Form, ...]:
    """The possible readings of a spelling, the likeliest first; at least one."""
    s = "".join(USUAL.get(c, c) for c in fold(name))
    if not s:  # nothing but remarks or nothing at all
        return (Form("", name, frozenset(), False),)
    for kana, word in KANA_WORDS.items():
        if s.endswith(kana) and len(s) > len(kana) + 1:
            s = s[: -len(kana)] + word
        elif s.endswith(kana + "高") and len(s) > len(kana) + 2:
            s = s[: -len(kana) - 1] + word + "高"
        elif s.startswith(kana) and len(s) > len(kana) + 1 and kana != "かん":
            s = word + s[len(kana) :]
    s = re.sub(r"第([1-5１-５])", lambda m: "第" + "一二三四五"[int(unicodedata.normalize("NFKC", m.group(1))) - 1], s)
    s = re.sub(r"(?<=[^\x00-\x7f])([1-5])(?=高?$)", lambda m: "第" + "一二三四五"[int(m.group(1)) - 1], s)
    out: list[Form] = []
    plain = s.replace("エフシー", "FC").replace("エスシー", "SC").replace("F.C.", "FC").replace("S.C.", "SC").replace(".", "")
    bare = plain[:-1] if plain.endswith("高") and len(plain) > 2 else plain
    ends = ""
    for end, full in CLUB_ENDS.items():
        if bare.endswith(end) and len(bare) > len(end):
            bare, ends = bare[: -len(end)], full
            break
        if bare.startswith(end) and len(bare) > len(end):
            bare, ends = bare[len(end) :], full
            break
    word = re.search("[ァ-ヴー]{2,}", bare.replace("インターナショナル", ""))
    club = word.group() if word and len(bare) > len(word.group()) else ""
    if ends:
        return (Form(club, _clean(bare.replace(club, "", 1)), frozenset(ends.split()), False),)
    rest = plain.replace(club, "", 1) if club else plain
    s, club = (rest, club) if club else (s, "")

    def add(base: str, suffix: str, high: bool) -> None:
        base = _clean(base)
        form = Form(club, base, frozenset(suffix.split()), high)
        if base and form not in out:
            out.append(form)

    s = READING.sub(lambda m: READINGS[m.group()], s)
    tails = [(s, False)]
    if s.endswith("高") and len(s) > 2:
        tails.append((s[:-1], True))
    for t, high in tails:
        if hit := next((x for x in BY_LENGTH if t.endswith(x) and len(t) > len(x)), None):
            add(t[: -len(hit)], SUFFIXES[hit], high)
            if len(hit) > 1 or len(_clean(t[: -len(hit)])) > 2:  # a whole suffix leaves no other reading
                return tuple(out)
    for t, high in tails:
        if hit := next((x for x in MOVABLE if t.startswith(x) and len(t) > len(x) + 1), None):
            add(t[len(hit) :], SUFFIXES[hit], high)
    for t, high in tails[::-1]:
        if t[-1] in SHORT and len(t) > 2 - high:
            add(t[:-1], SHORT[t[-1]], high)
    for t, high in tails[::-1]:
        add(t, "", high)
    return tuple(out) or (Form(club, _clean(s) or s or name, frozenset(), False),)


def base_distance(a: str, b: str) -> str | None:
    """'same', 'swap', 'drop' or 'other' (one character replaced) when one edit apart, else None."""
    if a == b:
        return "same"
    la, lb = len(a), len(b)
    if la == lb:
        diff = [i for i in range(la) if a[i] != b[i]]
        if len(diff) == 1 and la > 1:
            return "other"
        if len(diff) == 2 and a[diff[0]] == b[diff[1]] and a[diff[1]] == b[diff[0]] and diff[1] == diff[0] + 1:
            return "swap"
        if la > 1 and sorted(a) == sorted(b):
            return "swap" if la == 2 or a[1:] + a[:1] == b or b[1:] + b[:1] == a else None
    elif abs(la - lb) == 1:
        long, short = (a, b) if la > lb else (b, a)
        if len(short) >= 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long))):
            return "drop"
    return None


class Relation(NamedTuple):
    """kind: see `compare`; length of the longer base; replaced: the two characters that differ, for kind 'other'."""

    kind: str | None
    length: int
    replaced: str | None


def _only_suffix(a: str, b: str) -> bool:
    """Two bases one edit apart differ in a last or first character that stands for a suffix: sister schools."""
    if len(a) == len(b):
        return a[:-1] == b[:-1] and (a[-1] in ENDS or b[-1] in ENDS)
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return (long[:-1] == short and long[-1] in ENDS) or (long[1:] == short and long[0] in STARTS)


def _replaced(a: str, b: str) -> str:
    return "".join(sorted(next((x, y) for x, y in zip(a, b, strict=True) if x != y)))


def compare(a: str, b: str) -> Relation:
    """The nearest relation of two spellings over their readings.

    Kinds, from near to far: same, suffix (the same base, a suffix of which only a shortening is written), swap, drop,
    other (one character replaced); None when they are further apart.
    """
    best: tuple[int, Relation] = (9, Relation(None, 0, None))
    for fa in forms(a):
        for fb in forms(b):
            clubs = fa.club == fb.club
            if not clubs and fa.club and fb.club:
                continue
            if fa.suffix and fb.suffix:
                if not fa.suffix & fb.suffix:
                    continue
            elif fa.suffix or fb.suffix:
                continue
            rel = base_distance(fa.base, fb.base)
            if rel is None or (rel in ("drop", "other") and _only_suffix(fa.base, fb.base)):
                continue
            cost = {"same": 0, "swap": 2, "drop": 3, "other": 4}[rel] + (0 if clubs else 1)
            if cost == 0 and len(fa.suffix | fb.suffix) > 1:
                cost, rel = 1, "suffix"
            if not clubs and rel not in ("same", "drop"):
                continue
            if cost < best[0]:
                kind = rel if clubs or rel == "drop" else "suffix"
                best = cost, Relation(kind, max(len(fa.base), len(fb.base)), _replaced(fa.base, fb.base) if kind == "other" else None)
    return best[1]


def edit_keys(name: str) -> frozenset[int]:
    """Numbers of which spellings that `compare` relates share one: a suffix with the characters of a base regardless of
    order, whole or less one. For use within a process."""
    out: set[int] = set()
    for f in forms(name):
        whole = sum(hash(c) for c in f.base)
        for suffix in f.suffix or ("",):
            out.add(hash((suffix, whole)))
            out.update(hash((suffix, whole - hash(c))) for c in set(f.base))
    return frozenset(out)


def grams(name: str) -> list[str]:
    """Character n-grams with gaps, regardless of order, over all readings: the characters of the base and their pairs, for
    short bases also each character with the suffix, and the club word."""
    out: set[str] = set()
    for f in forms(name):
        chars = f.base[:-1] if f.base.endswith("高") and len(f.base) > 2 else f.base
        out |= {"".join(sorted((x, y))) for i, x in enumerate(chars) for y in chars[i + 1 :]} | set(chars)
        if len(chars) <= 2:
            out |= {f"{c}|{s}" for c in chars for s in (f.suffix or {"-"})}
        if f.club:
            out.add(f"{f.club}|")
    return sorted(out)
