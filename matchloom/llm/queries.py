"""The queries of this subpackage and the SQL that checks them, where SQL can say them."""

from __future__ import annotations

from . import entity_match, name_variants, packing, plain_form, skill, stuffing, survivor, token_tree


def queries() -> dict:
    return {
        "p1_found": name_variants.p1_found,
        "p1_classes": name_variants.p1_classes,
        "p2_found": plain_form.p2_found,
        "p2_plain": plain_form.p2_plain,
        "p3_found": survivor.p3_found,
        "p3_survivors": survivor.p3_survivors,
        "p4_found": entity_match.p4_found,
        "p4_confidence": entity_match.p4_confidence,
        "p5_ranking": skill.p5_ranking,
        "p6_ids": token_tree.p6_ids,
        "p7_pack": packing.p7_pack,
        "p8_found": stuffing.p8_found,
        "p8_scores": stuffing.p8_scores,
    }


def oracle_sql() -> dict[str, str]:
    """Only the plain forms can be said in SQL; the others are tested against brute force, round trips or fixtures."""
    plain = _plain_sql()
    found = plain.replace("select seq, field, case when field = 'チームA' then", "select seq, field, v, case when field = 'チームA' then")
    return {"p2_plain": plain, "p2_found": f"select seq, field from ({found}) where v <> plain"}


def _plain_sql() -> str:
    """The plain forms once more with SQL's own normalisation, for the characters that occur in the tables."""
    look = {
        "ΑА": "A", "ΒВ": "B", "СϹ": "C", "Ϝ": "F", "ΚК": "K", "ΟО": "O", "ΡР": "P", "Ѕ": "S", "ІΙ": "I", "‐‑‒–—−﹣－": "-", "⁄∕": "/", "･": "・",
    }
    src = "".join(look)
    dst = "".join(v * len(k) for k, v in look.items())
    drop = r"[\x{00AD}\x{180E}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]"
    space = r"[\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"

    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    digits = "".join(chr(0x1D7CE + i) for i in range(50))
    plain_digits = "0123456789" * 5
    letters = "".join(chr(0x1D5A0 + i) for i in range(26))
    from .plain_form import _tables

    # compatibility ideographs and radicals as the Unicode tables give them
    ideographs = [(a, b) for a, b in _tables()[0] if len(b) == 1 and (0x2E80 <= ord(a) <= 0x2FD5 or 0xF900 <= ord(a) <= 0xFAFF or 0x2F800 <= ord(a) <= 0x2FA1F)]
    half = [(a, b) for a, b in _tables()[0] if 0xFF66 <= ord(a) <= 0xFF9F and len(b) == 1]
    src += wide + digits + letters + "".join(a for a, _ in ideographs + half)
    dst += narrow + plain_digits + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(b for _, b in ideographs + half)
    q = lambda x: x.replace("'", "''")
    base = f"trim(nfc_normalize(translate(regexp_replace(regexp_replace(v, '{drop}', '', 'g'), '{space}', ' ', 'g'), '{q(src)}', '{q(dst)}')))"
    kana = "ァ-ヺー"
    words = base
    for k, c in (("エ", "工"), ("ロ", "口"), ("ニ", "二"), ("カ", "力"), ("タ", "夕"), ("ハ", "八"), ("ト", "卜"), ("ー", "一")):
        # RE2 has no look-around: neighbours are captured, twice for neighbours that touch
        for _ in range(2):
            words = rf"regexp_replace({words}, '(^|[^{kana}ヽヾ]){k}([^{kana}]|$)', '\1{c}\2', 'g')"
            words = rf"regexp_replace({words}, '([{kana}]){c}([{kana}])', '\1{k}\2', 'g')"
    digit = f"translate({base}, 'lI|Oo', '11100')"
    return f"""
        with long as (
            select seq, '日付' as field, "日付" as v from matches where "日付" is not null
            union all select seq, 'チームA', "チームA" from matches where "チームA" is not null
            union all select seq, 'スコア', "スコア" from matches where "スコア" is not null)
        select seq, field, case when field = 'チームA' then {words} else {digit} end as plain from long"""
