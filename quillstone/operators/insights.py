"""Rule table that turns phase metrics into insight rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Insight texts shown to users; %s takes the rule's number.
TEXTS = {
    "refs_many": "Baseline đa dạng với %s tài liệu tham khảo",
    "refs_none": "Không có baseline",
    "refs_few": "Chỉ %s tài liệu — verify sẽ hạn chế",
    "refs_found": "Baseline được tìm tự động",
    "topics_long": "Input dài — %s topics/file là bình thường",
    "cover_high": "Transcript cover %s%% baseline — toàn diện",
    "unique_low": "Thêm transcript với góc nhìn thực chiến",
    "gaps": "Còn %s lỗ hổng so với baseline",
    "gap_fill": "Bổ sung %s atoms từ baseline",
    "code": "Phát hiện %s code patterns",
    "sure": "Confidence %s%% — rất chính xác",
    "unsure": "Confidence thấp (%s%%)",
    "kept": "Giữ lại %s atoms",
    "dedup_high": "Dedup rate cao (%s%%) — data có nhiều trùng lặp",
    "unresolved": "%s conflicts chưa giải quyết",
    "cross": "%s mâu thuẫn giữa các nguồn",
    "draft": "Chỉ verify 30% (Draft tier)",
    "premium": "Verify 100% (Premium tier)",
    "all_pass": "100% pass",
    "flagged": "%s atoms bị flag",
    "tier_up": "Chạy lại với tier cao hơn",
    "pillars": "%s pillars kiến thức",
    "flagged_out": "%s atoms bị flag trong output",
    "packaged": "Đóng gói cho: %s",
}


def _m(name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col("metrics")[name], F.lit(default))


def _round(c: Column) -> Column:
    return F.floor(c + 0.5).cast("string")


def _int(c: Column) -> Column:
    return c.cast("long").cast("string")


def _rules() -> list[tuple[str, Column, str, str, Column | None, str | None]]:
    """(phase, condition, type, text key, number, priority); type action has a priority."""
    refs = _m("references")
    per_file = F.when(_m("transcripts_audited", 1.0) > 0, _m("topics_found") / _m("transcripts_audited", 1.0)).otherwise(0.0)
    total = _m("total")
    covered = total > 0
    over, uniq, gap = (F.when(covered, _m(n) / total).otherwise(0.0) for n in ("overlap_count", "unique_expert_count", "gap_count"))
    conf = _m("avg_confidence")
    inp, out = _m("input_atoms"), _m("output_atoms")
    rate = F.when(inp > 0, _m("duplicates_merged") / inp).otherwise(0.0)
    kept = F.when(inp > 0, _round(out / inp * 100)).otherwise("0")
    pct, flagged = _m("sample_pct"), _m("flagged")
    passed = (_m("verified") == _m("sampled")) & (flagged == 0) & (_m("sampled") > 0)
    return [
        ("p0", refs >= 10, "good", "refs_many", _int(refs), None),
        ("p0", refs == 0, "critical", "refs_none", None, None),
        ("p0", (refs > 0) & (refs < 5), "warning", "refs_few", _int(refs), None),
        ("p0", F.coalesce(F.col("source") == "auto-discovery", F.lit(False)), "info", "refs_found", None, None),
        ("p1", per_file > 100, "info", "topics_long", _round(per_file), None),
        ("p1", covered & (over > 0.8), "info", "cover_high", _round(over * 100), None),
        ("p1", covered & (uniq < 0.1), "action", "unique_low", None, "medium"),
        ("p1", covered & (gap > 0.5), "critical", "gaps", _int(_m("gap_count")), None),
        ("p1", covered & (gap > 0.2) & (gap <= 0.5), "warning", "gaps", _int(_m("gap_count")), None),
        ("p2", _m("gap_fill_atoms") > 0, "info", "gap_fill", _int(_m("gap_fill_atoms")), None),
        ("p2", _m("code_atoms") > 0, "info", "code", _int(_m("code_atoms")), None),
        ("p2", conf > 0.9, "good", "sure", _round(conf * 100), None),
        ("p2", (conf > 0) & (conf < 0.7), "warning", "unsure", _round(conf * 100), None),
        ("p3", F.lit(True), "info", "kept", F.concat(_int(out), F.lit("/"), _int(inp), F.lit(" ("), kept, F.lit("%)")), None),
        ("p3", rate > 0.6, "tip", "dedup_high", _round(rate * 100), None),
        ("p3", _m("conflicts_unresolved") > 0, "critical", "unresolved", _int(_m("conflicts_unresolved")), None),
        ("p3", _m("cross_source_contradictions") > 0, "warning", "cross", _int(_m("cross_source_contradictions")), None),
        ("p4", pct == 30, "warning", "draft", None, None),
        ("p4", pct == 100, "good", "premium", None, None),
        ("p4", passed, "good", "all_pass", None, None),
        ("p4", ~passed & (flagged > 0), "warning", "flagged", _int(flagged), None),
        ("p4", pct < 100, "action", "tier_up", None, "medium"),
        ("p5", F.lit(True), "info", "pillars", _int(_m("pillars")), None),
        ("p5", _m("atoms_flagged") > 0, "warning", "flagged_out", _int(_m("atoms_flagged")), None),
        ("p5", F.size("platforms") > 0, "good", "packaged", F.array_join("platforms", ", "), None),
    ]


def insights(results: DataFrame) -> DataFrame:
    """(build, phase, pos, type, text, priority) from rows (build, phase, metrics, source, platforms)."""
    rows = []
    for phase, cond, kind, key, number, priority in _rules():
        text = F.lit(TEXTS[key].replace("%%", "%")) if number is None else F.format_string(TEXTS[key], number)
        rows.append(F.when((F.col("phase") == phase) & cond, F.struct(
            F.lit(kind).alias("type"), text.alias("text"), F.lit(priority).cast("string").alias("priority"))))
    found = F.filter(F.array(*rows), lambda r: r.isNotNull())
    return results.select("build", "phase", F.posexplode(found).alias("pos", "i")).select("build", "phase", "pos", "i.*")


def breakdown(results: DataFrame) -> DataFrame:
    """Score components of the audit phase: density, balance and the estimated rest."""
    audited = _m("transcripts_audited", 1.0)
    per_file = F.when(audited > 0, _m("topics_found") / audited).otherwise(0.0)
    density = F.when(per_file > 0, F.least(_m("topics_found") / 5, F.lit(100.0))).otherwise(50.0)
    total = _m("total")
    covered = total > 0
    balance = F.greatest(F.lit(0.0), F.floor((1 - _m("gap_count") / total) * 100 + 0.5).cast("double"))
    score = F.coalesce("quality_score", F.lit(0.0))
    rest = F.when(covered, (score - density * 0.3 - balance * 0.25) / 0.45).otherwise((score - density * 0.3) / 0.7)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), rest))

    def part(name: str, value: Column, weight: Column, shown: Column) -> Column:
        level = F.when(value >= 70, "good").when(value >= 50, "warning").otherwise("critical")
        return F.struct(F.lit(name).alias("component"), shown.cast("double").alias("score"), weight.cast("int").alias("weight"), level.alias("status"))

    parts = F.array(
        part("Density", density, F.lit(30), density),
        F.when(covered, part("Balance", balance, F.lit(25), balance)),
        part("Depth + Category", clamped, F.when(covered, 45).otherwise(70), F.floor(clamped + 0.5)))
    return results.filter("phase = 'p1'").select(
        "build", F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p")).select("build", "p.*")
