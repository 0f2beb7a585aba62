"""Choosing between the texts that two recognisers read for the same crop."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import remove_accents

# Accented letters that count, lower case except đ.
ACCENTS = "áàảãạăắằẳẵặâấầẩẫậéèẻẽẹêếềểễệíìỉĩịóòỏõọôốồổỗộơớờởỡợúùủũụưứừửữựýỳỷỹỵđĐ"
_CURRENCY = r"^\d{1,3}(?:\.\d{3})+(?:\s*[đdD])?$"
_LABEL = r"^(Ngày|Điện thoại|Số|MST|Diễn giải|Khách hàng|Địa chỉ|Đơn giá|Thành tiền|Tổng tiền|Cộng tiền|Tiền thuế)"
_CODE = r"^[A-Z0-9\-_()/:#]{3,}$"


def accent_count(text: Column, fold_case: bool = False) -> Column:
    """Accented letters of a text; capitals count only with fold_case (but for Đ)."""
    t = F.lower(text) if fold_case else text
    return F.length(t) - F.length(F.translate(t, ACCENTS, ""))


def mostly_digits(text: Column, share: float = 0.35) -> Column:
    """Whether a text is a number or code: digits make up the share of it, or a label says so."""
    bare = F.regexp_replace(text, r"[\s.,\-/:()]", "")
    digits = F.length(F.regexp_replace(bare, r"[^0-9]", ""))
    return ((F.length(bare) > 0) & (digits >= share * F.length(bare))) | text.rlike(r"(?i)^(mst|stk|tel|fax|sđt|đt)\b")


def arbitrate(paddle: Column, paddle_conf: Column, viet: Column, viet_conf: Column, fold_case: bool = False) -> Column:
    """(text, conf, winner) of the first rule that holds; null texts and confidences count as empty and 0."""
    p, v = F.trim(F.coalesce(paddle, F.lit(""))), F.trim(F.coalesce(viet, F.lit("")))
    pc, vc = F.coalesce(paddle_conf, F.lit(0.0)), F.coalesce(viet_conf, F.lit(0.0))
    pa, va = accent_count(p, fold_case), accent_count(v, fold_case)
    pick = lambda t, c, w: F.struct(t.alias("text"), F.round(c, 6).alias("conf"), F.lit(w).alias("winner"))
    return (
        F.when((p == "") & (v == ""), pick(F.lit(""), F.lit(0.0), "none"))
        .when(p == "", pick(v, vc, "vietocr"))
        .when(v == "", pick(p, pc, "paddleocr"))
        .when(F.lower(remove_accents(p)) == F.lower(remove_accents(v)), pick(v, F.greatest(vc, pc, F.lit(0.98)), "cross_verified"))
        .when(v.rlike(_CURRENCY) & ~p.rlike(_CURRENCY), pick(v, F.greatest(vc, F.lit(0.96)), "vietocr"))
        .when(v.rlike(_LABEL) & (va > pa), pick(v, F.greatest(vc, F.lit(0.95)), "vietocr"))
        .when(p.rlike(_CODE) & (va == 0) & (pc >= 0.65), pick(p, F.greatest(pc, F.lit(0.95)), "paddleocr"))
        .when((va > pa) & (va >= 1), pick(v, F.greatest(vc, F.lit(0.94)), "vietocr"))
        .when((pc > 0.92) & (vc < 0.70), pick(p, pc, "paddleocr"))
        .otherwise(pick(v, F.greatest(vc, pc), "vietocr"))
    )
