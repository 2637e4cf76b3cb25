"""Annual, quarterly and monthly firm characteristics over a firm-by-period panel.

Each catalogue is a set of layers: fills and lags first, then ratios, then what is compared with
the industry.  All lags of a catalogue share one window, so a panel is sorted once.
"""

from __future__ import annotations

from tessera.functions.exprs import Layers, Panel, div, flag, safe_log, signed_ratio

#: Statement items of the annual characteristics.
ANNUAL_INPUTS = (
    "sale at act che lct dlc txp dp lt cogs xsga ppent ppegt invt rect ceq emp csho prcc_f ib gdwl capx dvt dltt ebit nopi xrd "
    "revt oancf spi xad gdwlia gdwlip gwo fatb fatl ob dm dcvt cshrc aco intan ao ap lco lo drc drlt xint ni scstkc txfo txfed"
).split()
_LAGGED = "at act che lct dlc txp lt sale cogs xsga dp ppent ppegt invt rect ceq emp csho ib gdwl dvt xad ob aco intan ao ap lco lo xrd ni dltt".split()

#: Industry and product codes of the sin-stock screen.
SIN_SIC_RANGES = [(2100, 2199), (2080, 2085)]
SIN_NAICS = ["7132", "71312", "713210", "71329", "713290", "72112", "721120"]

#: Characteristics that also come as deviation from their industry-year mean.
INDUSTRY_ADJUSTED = (
    "chpm chato bm cfp hire mve_f pchcapx tb_1 acc absacc pctacc chinv spii spi cf pchsale_pchinvt pchsale_pchrect pchgm_pchsale "
    "pchsale_pchxsga depr pchdepr chadv invest egr capxint xadint xrdint grcapx grgw tang currat pchcurrat quick pchquick salecash "
    "salerec saleinv pchsaleinv cashdebt realestate divi divo obklg chobklg secured conv grltnoa chdrc rd rdbias roe operprof ps "
    "roa cfroa lev sp ep dy agr gma"
).split()


def growth(x: str) -> str:
    return div(f"{x} - l_{x}", f"l_{x}")


def relative_change(now: str, before: str) -> str:
    return div(f"{now} - {before}", before)


def _missing_cash_flow(present: str, absent: str) -> str:
    return f"(CASE WHEN oancf IS NULL THEN {absent} ELSE {present} END)"


def annual_layers(entity: str = "gvkey", time: str = "datadate", industry_codes: bool = True) -> Layers:
    p = Panel(entity, time)
    start = {f"l_{x}": p.lag(x) for x in _LAGGED} | {
        "l2_at": p.lag("at", 2),
        "xint0": "coalesce(xint, 0)",
        "xsga0": "coalesce(xsga, 0)",
        "mve_f": "csho * abs(prcc_f)",
        "dr": "CASE WHEN drc IS NOT NULL AND drlt IS NOT NULL THEN drc + drlt ELSE coalesce(drc, drlt) END",
        "capx": f"coalesce(capx, ppent - {p.lag('ppent')})",
        "act": "coalesce(act, che + rect + invt)",
        "lct": "coalesce(lct, ap)",
        "act_raw": "act",
        "lct_raw": "lct",
    }
    # Lags named l_act and l_lct are of the values before the fill; the score's own lags are after it.
    later = {
        "l_capx": p.lag("capx"),
        "l2_capx": p.lag("capx", 2),
        "l_dr": p.lag("dr"),
        "f_act": p.lag("act"),
        "f_lct": p.lag("lct"),
        "avg_at": "(at + l_at) / 2.0",
        "bs_acc": "(act_raw - l_act) - (che - l_che) - ((lct_raw - l_lct) - (dlc - l_dlc) - (txp - l_txp) - dp)",
        "noa": "rect + invt + ppent + aco + intan + ao - (ap + lco + lo)",
        "l_noa": "l_rect + l_invt + l_ppent + l_aco + l_intan + l_ao - (l_ap + l_lco + l_lo)",
        "spi_raw": "spi",
    }
    over_value = {"bm": "ceq", "ep": "ib", "dy": "dvt", "lev": "lt", "sp": "sale", "rd_mve": "xrd"}
    over_assets = {"spi": "spi_raw", "obklg": "ob", "xrdint": "xrd", "capxint": "capx", "xadint": "xad", "roa": "ni"}
    simple = {k: div(x, "mve_f") for k, x in over_value.items()} | {k: div(x, "avg_at") for k, x in over_assets.items()}
    changes = {"agr": "at", "chcsho": "csho", "lgr": "lt", "sgr": "sale", "egr": "ceq"}
    simple |= {k: growth(x) for k, x in changes.items()}
    against_sales = {"pchsale_pchinvt": "invt", "pchsale_pchrect": "rect", "pchsale_pchxsga": "xsga"}
    simple |= {k: f"{growth('sale')} - {growth(x)}" for k, x in against_sales.items()}
    turns = {"salecash": "che", "salerec": "rect", "saleinv": "invt"}
    simple |= {k: div("sale", x) for k, x in turns.items()}
    margin, l_margin = "(sale - cogs)", "(l_sale - l_cogs)"
    plant = "(CASE WHEN ppegt IS NULL THEN ppent ELSE ppegt END)"
    d_plant = "(CASE WHEN ppegt IS NULL THEN ppent - l_ppent ELSE ppegt - l_ppegt END)"
    held = "(rect - l_rect) + (invt - l_invt) + (aco - l_aco) - ((ap - l_ap) + (lco - l_lco)) - dp"
    accrual = _missing_cash_flow("ib - oancf", "bs_acc")
    ratios = simple | {
        "cashpr": div("mve_f + dltt - at", "che"),
        "roic": div("ebit - nopi", "ceq + lt - che"),
        "rd_sale": div("xrd", "sale"),
        "gma": div("revt - cogs", "l_at"),
        "hire": f"CASE WHEN emp IS NULL OR l_emp IS NULL THEN 0 ELSE {growth('emp')} END",
        "acc": div(accrual, "avg_at"),
        "pctacc": f"CASE WHEN ib = 0 THEN {accrual} / 0.01 ELSE {accrual} / abs(ib) END",
        "cfp": div(_missing_cash_flow("oancf", "ib - bs_acc"), "mve_f"),
        "cf": div(_missing_cash_flow("oancf", "ib - bs_acc"), "avg_at"),
        "cfroa": div(_missing_cash_flow("oancf", "ib + dp"), "avg_at"),
        "chinv": div("invt - l_invt", "avg_at"),
        "spii": flag("spi_raw <> 0"),
        "chpm": f"{div('ib', 'sale')} - {div('l_ib', 'l_sale')}",
        "chato": f"{div('sale', 'avg_at')} - {div('l_sale', '(l_at + l2_at) / 2.0')}",
        "pchgm_pchsale": f"{relative_change(margin, l_margin)} - {growth('sale')}",
        "depr": div("dp", "ppent"),
        "pchdepr": relative_change(div("dp", "ppent"), div("l_dp", "l_ppent")),
        "chadv": f"{safe_log('1 + xad')} - {safe_log('1 + l_xad')}",
        "invest": div(f"{d_plant} + (invt - l_invt)", "l_at"),
        "pchcapx": growth("capx"),
        "grcapx": relative_change("capx", "l2_capx"),
        "grgw": f"CASE WHEN coalesce(gdwl, 0) = 0 THEN 0 ELSE {growth('gdwl')} END",
        "wogw": flag("coalesce(gdwlia, 0) <> 0 OR coalesce(gdwlip, 0) <> 0 OR coalesce(gwo, 0) <> 0"),
        "tang": div("che + rect * 0.715e0 + invt * 0.547e0 + ppent * 0.535e0", "at"),
        "currat": div("act", "lct"),
        "pchcurrat": relative_change(div("act", "lct"), div("l_act", "l_lct")),
        "quick": div("act - invt", "lct"),
        "pchquick": relative_change(div("act - invt", "lct"), div("l_act - l_invt", "l_lct")),
        "pchsaleinv": relative_change(div("sale", "invt"), div("l_sale", "l_invt")),
        "cashdebt": div("ib + dp", "(lt + l_lt) / 2.0"),
        "realestate": div("fatb + fatl", plant),
        "divi": flag("dvt > 0 AND coalesce(l_dvt, 0) = 0"),
        "divo": flag("coalesce(dvt, 0) = 0 AND l_dvt > 0"),
        "chobklg": div("ob - l_ob", "avg_at"),
        "securedind": flag("dm <> 0"),
        "secured": div("dm", "dltt"),
        "convind": flag("coalesce(dcvt, 0) <> 0 OR coalesce(cshrc, 0) <> 0"),
        "conv": div("dcvt", "dltt"),
        "grltnoa": div(f"noa - l_noa - ({held})", "avg_at"),
        "chdrc": div("dr - l_dr", "avg_at"),
        "rd": flag(f"{signed_ratio(signed_ratio('xrd', 'at') + ' - ' + signed_ratio('l_xrd', 'l_at'), signed_ratio('l_xrd', 'l_at'))} > 0.05"),
        "rdbias": f"{div('xrd', 'l_xrd')} - 1 - {div('ib', 'l_ceq')}",
        "roe": div("ib", "l_ceq"),
        "operprof": div("revt - cogs - xsga0 - xint0", "l_ceq"),
        "tb_1": div("(txfo + txfed) / 0.35e0", "ib"),
        "ps": " + ".join(
            flag(c)
            for c in (
                "ni > 0",
                "oancf > 0",
                f"{signed_ratio('ni', 'at')} > {signed_ratio('l_ni', 'l_at')}",
                "oancf > ni",
                f"{signed_ratio('dltt', 'at')} < {signed_ratio('l_dltt', 'l_at')}",
                f"{signed_ratio('act', 'lct')} > {signed_ratio('f_act', 'f_lct')}",
                f"{signed_ratio(margin, 'sale')} > {signed_ratio(l_margin, 'l_sale')}",
                f"{signed_ratio('sale', 'at')} > {signed_ratio('l_sale', 'l_at')}",
                "scstkc = 0",
            )
        ),
    }
    last = {"absacc": "abs(acc)"}
    if industry_codes:
        ranges = " OR ".join(f"CAST(sic AS INT) BETWEEN {a} AND {b}" for a, b in SIN_SIC_RANGES)
        last |= {"sin": flag(f"{ranges} OR naics IN ({', '.join(repr(n) for n in SIN_NAICS)})"), "sic2": "substr(sic, 1, 2)"}
    return Layers(start, later, ratios, last)


#: Names of the annual characteristics.
ANNUAL_FACTORS = (
    "bm ep cashpr dy lev sp roic rd_sale rd_mve agr gma chcsho lgr sgr hire acc pctacc absacc cfp chinv spii spi cf chpm chato "
    "pchsale_pchinvt pchsale_pchrect pchgm_pchsale pchsale_pchxsga depr pchdepr chadv invest egr pchcapx grcapx grgw wogw tang sin "
    "currat pchcurrat quick pchquick salecash salerec saleinv pchsaleinv cashdebt realestate divi divo obklg chobklg securedind "
    "secured convind conv grltnoa chdrc rd rdbias roe operprof ps tb_1 roa cfroa xrdint capxint xadint"
).split()


def industry_adjusted(names: list[str], keys: str = "fyear, sic2") -> Layers:
    """x less its mean in the group, as x_ia; one window for all."""
    return Layers({f"{n}_ia": f"{n} - avg({n}) OVER (PARTITION BY {keys})" for n in names})


#: Statement items and names of the quarterly characteristics.
QUARTERLY_INPUTS = "ibq atq cshoq prccq saleq txtq seqq actq cheq lctq dlcq ppentq".split()
QUARTERLY_FACTORS = "roaq mveq rsup sue roavol chtx roeq sacc stdacc sgrvol scf stdcf cash cinvest nincr aeavol ear".split()


def quarterly_layers(entity: str = "gvkey", time: str = "datadate") -> Layers:
    p = Panel(entity, time)
    lags = {f"l_{x}": p.lag(x) for x in QUARTERLY_INPUTS}
    lags |= {f"l{k}_{x}": p.lag(x, k) for x, k in (("ibq", 4), ("saleq", 4), ("atq", 4), ("txtq", 4))}
    lags["mveq"] = "cshoq * abs(prccq)"
    lags["up"] = flag(f"ibq > {p.lag('ibq')}")

    def per_sale(x: str) -> str:
        return f"(CASE WHEN saleq <= 0 THEN ({x}) / 0.01 ELSE ({x}) / nullif(saleq, 0) END)"

    ratios = {
        "roaq": div("ibq", "l_atq"),
        "rsup": div("saleq - l4_saleq", "mveq"),
        "sue": div("ibq - l4_ibq", "mveq"),
        "chtx": div("txtq - l4_txtq", "l4_atq"),
        "roeq": div("ibq", "l_seqq"),
        "sacc": per_sale("(actq - l_actq) - (cheq - l_cheq) - ((lctq - l_lctq) - (dlcq - l_dlcq))"),
        "cash": div("cheq", "atq"),
        "cinvest_term": per_sale("ppentq - l_ppentq"),
        # Rises in a row, up to eight: the products of the last 1, 2, .. 8 flags.
        "nincr": " + ".join(f"coalesce(min(up) OVER {p.frame(k)}, 0) * {flag(f'count(up) OVER {p.frame(k)} = {k}')}" for k in range(1, 9)),
        "aeavol": "CAST(NULL AS DOUBLE)",
        "ear": "CAST(NULL AS DOUBLE)",
    }
    second = {"scf": f"{per_sale('ibq')} - sacc", "roavol": p.roll("stddev_samp", "roaq", 16, 8), "sgrvol": p.roll("stddev_samp", "rsup", 15, 8)}
    third = {
        "stdacc": p.roll("stddev_samp", "sacc", 16, 8),
        "stdcf": p.roll("stddev_samp", "scf", 16, 8),
        "cinvest": f"cinvest_term - {p.roll('avg', 'cinvest_term', 3, 3, shift=1)}",
    }
    return Layers(lags, ratios, second, third)


#: Names of the monthly characteristics.
MONTHLY_FACTORS = "mom1m mom6m mom12m mom36m chmom retvol mve_m mve turn dolvol retcons_pos retcons_neg ipo ewmkt beta idiovol betasq".split()


def monthly_layers(entity: str = "permno", time: str = "date") -> Layers:
    """From ret, prc, vol, shrout.  Momenta fold their lag into the frame."""
    p = Panel(entity, time)

    def momentum(n: int, least: int, shift: int) -> str:
        w = p.frame(n, shift)
        return f"(CASE WHEN count(lret) OVER {w} >= {least} THEN exp(sum(lret) OVER {w}) - 1 END)"

    def in_a_row(sign: str) -> str:
        w = p.frame(6, 1)
        return flag(f"count(CASE WHEN ret {sign} 0 THEN 1 END) OVER {w} = 6")

    first = {"lret": "CASE WHEN ret > -1 THEN ln(1 + ret) END", "mve_m": "abs(prc) * shrout"}
    second = {
        "mom1m": p.lag("ret"),
        "mom6m": momentum(5, 4, 2),
        "mom12m": momentum(11, 8, 2),
        "mom36m": momentum(24, 12, 13),
        "older6": momentum(6, 4, 7),
        "retvol": p.roll("stddev_samp", "ret", 36, 24),
        "mve": safe_log(p.lag("mve_m")),
        "turn": div(f"avg(vol) OVER {p.frame(3, 1)}", "shrout"),
        "dolvol": safe_log(f"({p.lag('vol', 2)}) * ({p.lag('abs(prc)', 2)})"),
        "retcons_pos": in_a_row(">"),
        "retcons_neg": in_a_row("<"),
        "ipo": flag(f"{p.row()} <= 12"),
        "ewmkt": f"avg(ret) OVER (PARTITION BY {time})",
        "beta": "CAST(NULL AS DOUBLE)",
        "idiovol": "CAST(NULL AS DOUBLE)",
        "betasq": "CAST(NULL AS DOUBLE)",
    }
    return Layers(first, second, {"chmom": "mom6m - older6"})


VALUE_RATIOS = Layers({"ep_m": div("ib", "mve_m"), "bm_m": div("ceq", "mve_m"), "sp_m": div("sale", "mve_m")})


def momentum_suite(entity: str, time: str, longest: int = 24) -> Layers:
    """mom1 .. mom{longest}: compounded over the last i periods, all of which must be there."""
    p = Panel(entity, time)
    logs = Layers({"lret": "CASE WHEN ret > -1 THEN ln(1 + ret) END"})
    return logs + Layers({f"mom{i}": f"(CASE WHEN count(lret) OVER {p.frame(i, 1)} >= {i} THEN exp(sum(lret) OVER {p.frame(i, 1)}) - 1 END)" for i in range(1, longest + 1)})
