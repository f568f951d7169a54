"""Texts and maps whose exact content is part of the results.

They are plain data. Nothing here is derived.
"""

from __future__ import annotations

# --- fixed values: page labels -------------------------------------------------
SEVERITY_LABELS = {
    "CRITICAL": "KRİTİK",
    "HIGH": "YÜKSEK",
    "MEDIUM": "ORTA",
    "LOW": "DÜŞÜK",
}
RISK_LABELS = {
    "CHURN_RISK": "Kayıp Riski",
    "MARGIN_RISK": "Marj Baskısı",
    "BOTH": "Her İkisi",
}
SEVERITY_ICONS = {
    "CRITICAL": "🔴",
    "HIGH": "🟠",
    "MEDIUM": "🟡",
    "LOW": "🟢",
}
DEFAULT_ICON = "⚪"

# --- fixed values: metric labels and notes per risk type --------------------------
METRIC_LABELS = {
    "CHURN_RISK": "Sipariş Düşüşü",
    "MARGIN_RISK": "Marj Baskısı",
    "BOTH": "Risk Skoru",
}
MARGIN_NOTE = "-Kritik"
SCORE_NOTE = "-Dikkat"

# --- fixed values: what a card shows when no strategy exists ----------------------
NO_TITLE = "Belirlenmedi"
NO_RATIONALE = "Gerekçe bulunmuyor."
NO_STEP = "Henüz aksiyon adımı belirlenmedi."

# --- fixed values: text when a step receives nothing -------------------------------
NO_FINDINGS_LINE = "No risk findings provided."
NO_STRATEGIES_LINE = "No recommendations provided."
NO_RISK_SUMMARY = "No risks detected; no strategies required."

# --- fixed values: link prefix ------------------------------------------------------
SHARE_PREFIX = "https://wa.me/?text="

# --- fixed values: severity order, urgency and priority -----------------------------
SEVERITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
SEVERITY_PRIORITY = {"LOW": "LOW", "MEDIUM": "MEDIUM", "HIGH": "HIGH", "CRITICAL": "URGENT"}
