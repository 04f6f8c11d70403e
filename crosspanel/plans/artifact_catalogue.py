"""Signals of 48 generated artifacts, in the engine's grammar: row axis, two-valued conditions, no final form.

``only(c, x)`` is x where c holds, else missing; ``pick(c, a, b)`` takes b where c is missing too. A failed call has no
formula; one formula can't be built with its own defaults, as it asks for more rows than its window has.
"""

from __future__ import annotations

from .expr import Node, parse

# Themes, formulas and default parameters of the artifacts.
ARTIFACTS: dict[str, tuple[str, str | None, dict[str, float]]] = {
    "alpha_0a22b5d9": (
        "beta",
        "m = xmean(returns); n = ts_count(returns, N_beta);"
        "cov = (mean_min(returns * m, N_beta, min_obs_beta) - mean_min(returns, N_beta, min_obs_beta) * mean_min(m, N_beta, min_obs_beta)) * (n / (n - 1));"
        "v = var_min(m, N_beta, min_obs_beta); b = cov / only(v > 1e-12, v); e = returns - b * m; s = std_min(e, N_eps, min_obs_eps);"
        "zscore_zero(mean_min(e, N_eps, min_obs_eps) / only(s > 1e-12, s), 1e-12) - lambda_beta * zscore_zero(b, 1e-12)",
        {"N_beta": 60, "min_obs_beta": 40, "N_eps": 20, "min_obs_eps": 15, "lambda_beta": 0.5},
    ),
    "alpha_0e5ad6e0": (
        "volatility",
        "down = sqrt(ts_mean(emin(returns, 0) * emin(returns, 0), N_vol)); up = sqrt(ts_mean(emax(returns, 0) * emax(returns, 0), N_vol));"
        "-1 * zscore_eps(ts_mean((down - up) / (down + up + eps), N_smooth), eps)",
        {"N_vol": 20, "N_smooth": 5, "eps": 1e-8},
    ),
    "alpha_22470197": (
        "short_term_reversal",
        "d = stddev(returns, N_vol) * sqrt(N_ret);"
        "mean_min(isfinite(zscore(isfinite(-1 * (ts_sum(returns, N_ret) / only(d > 0, d)) * isfinite(volume / ts_mean(volume, N_adv))))), N_smooth, 1)",
        {"N_ret": 3, "N_vol": 20, "N_adv": 20, "N_smooth": 3},
    ),
    "alpha_310a2d1a": ("liquidity", None, {}),
    "alpha_31f9149c": (
        "beta",
        "m = xmean(returns); mm = mean_min(m, N_beta, min_obs_beta); cov = mean_min(returns * m, N_beta, min_obs_beta) - mean_min(returns, N_beta, min_obs_beta) * mm;"
        "v = mean_min(m * m, N_beta, min_obs_beta) - mm * mm; e = returns - cov / emax(v, eps) * m;"
        "s = mean_min(e, N_mom, min_obs_mom) / emax(std_min(e, N_mom, min_obs_mom), eps); demean(s) / emax(xstd(s), eps)",
        {"N_beta": 60, "N_mom": 20, "min_obs_beta": 40, "min_obs_mom": 15, "eps": 1e-8},
    ),
    "alpha_3221e96b": (
        "beta",
        "m = xmean(returns); mm = ts_mean(m, N_beta); cov = ts_mean(returns * m, N_beta) - ts_mean(returns, N_beta) * mm; v = emax(ts_mean(m * m, N_beta) - mm * mm, 0);"
        "e = returns - cov / (v + eps) * m; zscore_eps((ts_sum(e, N_mom) - ts_sum(e, N_skip)) / (stddev(e, N_mom) + eps), eps)",
        {"N_beta": 60, "N_mom": 20, "N_skip": 1, "eps": 1e-8},
    ),
    "alpha_3c2f1bc5": (
        "volatility",
        "h = log(high / low); p = sqrt(emax(ts_mean(h * h / (4 * log(2)), N_park), 0));"
        "zscore_eps(-1 * (p / (stddev(returns, N_cc) + eps)) * expm1(ts_sum(log1p(returns), N_ret)), eps)",
        {"N_park": 5, "N_cc": 20, "N_ret": 5, "eps": 1e-6},
    ),
    "alpha_4502b5af": (
        "momentum",
        "v = stddev(returns, N_vol); l = ts_mean(volume, N_vlong);"
        "zscore_fill(ts_mean(where(v > 0, delta(log(close), N_mom) / v, 0) * where(l > 0, ts_mean(volume, N_vshort) / l, 1), N_smooth))",
        {"N_mom": 20, "N_vol": 20, "N_vshort": 5, "N_vlong": 60, "N_smooth": 3},
    ),
    "alpha_6a1a6f8d": (
        "trading_volume",
        "zscore_eps(ts_mean((close - open) / ((high - low) + eps_price) * ((volume - ts_mean(volume, N_vol)) / (stddev(volume, N_vol) + eps_vol)), N_smooth), eps_cs)",
        {"N_vol": 20, "N_smooth": 5, "eps_price": 1e-8, "eps_vol": 1e-8, "eps_cs": 1e-8},
    ),
    "alpha_78ebbccf": (
        "liquidity",
        "i = abs(returns) / (close * volume + delta); fill(-1 * zscore_eps(ts_mean((i - ts_mean(i, N_mem)) / (stddev(i, N_mem) + eps) * returns, N_smooth), eps), 0)",
        {"N_mem": 20, "N_smooth": 5, "delta": 1e-8, "eps": 1e-6},
    ),
    "alpha_8047543a": (
        "trading_volume",
        "up = pick(returns > 0, volume, 0); down = pick(returns < 0, volume, 0);"
        "zscore_eps((ts_sum(up, N_short) - ts_sum(down, N_short)) / (ts_sum(volume, N_short) + eps) - (ts_sum(up, N_long) - ts_sum(down, N_long)) / (ts_sum(volume, N_long) + eps), eps)",
        {"N_short": 5, "N_long": 21, "eps": 1e-8},
    ),
    "alpha_8a8df75c": (
        "long_term_reversal",
        "r = delay(log(close), N_lag) - delay(log(close), N_lookback); ts_mean(-1 * zscore_eps(r / (stddev(returns, N_vol) * sqrt(N_year) + eps), eps), N_smooth)",
        {"N_lookback": 252, "N_lag": 21, "N_vol": 252, "N_smooth": 5, "N_year": 252, "eps": 1e-6},
    ),
    "alpha_96a96551": (
        "volatility",
        "r = (high - low) / close; zscore_eps(-1 * ((2 * close - (high + low)) / (high - low + eps)) * (r / (ts_mean(r, N_vol) + eps)), eps)",
        {"N_vol": 20, "eps": 1e-8},
    ),
    "alpha_97aeb2d8": (
        "nearness_to_the_52_week_high",
        "l = ts_mean(volume, N_long_vol); x = close / ts_max(high, N_high) * (ts_mean(volume, N_short_vol) / only(l > 0, l)); where(xstd(x) > 0, zscore(x), x * 0)",
        {"N_high": 252, "N_short_vol": 5, "N_long_vol": 60},
    ),
    "alpha_9aab3d1e": (
        "liquidity",
        "i = abs(returns) / (close * volume + epsilon); z = (i - mean_min(i, N_slow, min_obs)) / (std_min(i, N_slow, min_obs) + epsilon); zscore_eps(mean_min(-1 * returns * z, N_smooth, 1), epsilon)",
        {"N_slow": 60, "N_smooth": 3, "epsilon": 1e-8, "min_obs": 40},
    ),
    "alpha_a10e2afe": (
        "momentum",
        "fill(isfinite(zscore(isfinite((delay(close, N_lag) / delay(close, N_mom) - 1) / std_min(returns, N_vol, min_obs)))), 0)",
        {"N_mom": 126, "N_lag": 5, "N_vol": 60, "min_obs": 60},
    ),
    "alpha_a728eba6": (
        "nearness_to_the_52_week_high",
        "isfinite(zscore_zero(isfinite(close / max_min(high, N_high, min_obs)) * isfinite(ts_mean(volume, N_vol_short) / mean_min(volume, N_vol_long, min_obs)), 0))",
        {"N_high": 252, "N_vol_short": 5, "N_vol_long": 60, "min_obs": 126},
    ),
    "alpha_ac177fa4": (
        "nearness_to_the_52_week_high",
        "a = ts_mean(volume, N_vol); z = zscore_zero(close / ts_max(high, N_lookback) * emin(where(a > 0, volume / a, 1), V_cap), 0); only(cumcount(z) >= N_smooth, ewm(z, N_smooth))",
        {"N_lookback": 252, "N_vol": 20, "V_cap": 3, "N_smooth": 5},
    ),
    "alpha_c0c1ca4f": (
        "long_term_reversal",
        "s = expm1(ts_sum(delay(log1p(returns), N_short), N_long - N_short)) / emax(std_min(returns, N_vol, min_periods_vol), eps);"
        "where(xcount(s) >= 2, -1 * (demean(s) / emax(xstd(s), eps)), s * 0)",
        {"N_long": 252, "N_short": 21, "N_vol": 252, "min_periods_vol": 126, "eps": 1e-8},
    ),
    "alpha_c1754043": (
        "short_term_reversal",
        "isfinite(zscore(isfinite(-1 * (pct_change(close, N_rev) / (std_min(returns, N_vol, min_obs) * sqrt(N_rev))) * (volume / mean_min(volume, N_vol, min_obs)))))",
        {"N_rev": 3, "N_vol": 20, "min_obs": 20},
    ),
    "alpha_cf45008b": (
        "momentum",
        "m = pct_change(close, N_mom) / (stddev(returns, N_vol) * sqrt(N_mom) + epsilon); zscore_eps(m * ewm_rec(volume / (ts_mean(volume, N_vol_volume) + epsilon), N_smooth), epsilon)",
        {"N_mom": 21, "N_vol": 63, "N_vol_volume": 21, "N_smooth": 5, "epsilon": 1e-8},
    ),
    "alpha_d8be488a": (
        "trading_volume",
        "w = high - low; a = ts_mean(volume, N_vol); p = pick(w > 0, (2 * close - high - low) / w, 0) * pick(a > 0, volume / a, 0); sp = ts_mean(p, N_smooth); sd = stddev(p, N_vol);"
        "zscore_zero(where(sd > 0, sp / sd, sp * 0), 0)",
        {"N_vol": 20, "N_smooth": 5},
    ),
    "alpha_e31df18b": ("short_term_reversal", "d = std_min(returns, N_vol, min_obs) * sqrt(N_ret); -1 * zscore(pct_change(close, N_ret) / only(d > 0, d))", {"N_ret": 3, "N_vol": 20, "min_obs": 20}),
    "alpha_f0d9f6b4": (
        "long_term_reversal",
        "b = delay(close, N_lookback); v = stddev(returns, N_lookback);"
        "isfinite(-1 * zscore(isfinite(only(b > 0, delay(close, N_skip) / b - 1) / (only(v > 0, v) * sqrt(N_lookback - N_skip)))))",
        {"N_lookback": 252, "N_skip": 21},
    ),
    "alpha_06eaa5d7": (
        "momentum",
        "b = isfinite(delay(close, N_skip + N_mom)); m = only(abs(b) > 0, isfinite(delay(close, N_skip)) / b - 1); k = stddev_pop(isfinite(delay(returns, N_skip)), N_mom) * sqrt(N_mom);"
        "rank_centered(isfinite(only(k > 0, m / k)), N_cs_min)",
        {"N_mom": 126, "N_skip": 5, "N_cs_min": 2},
    ),
    "alpha_0b7a9845": (
        "short_term_reversal",
        "d = isfinite(ts_sum(returns, N_rev) / ts_mean(isfinite((high - low) / close), N_range)); v = isfinite(volume / ts_mean(volume, N_vol));"
        "rank(least_names((0.5 - rank(least_names(d, N_cs))) * (1 - rank(least_names(v, N_cs))), N_cs)) - 0.5",
        {"N_rev": 3, "N_range": 20, "N_vol": 20, "N_cs": 50},
    ),
    "alpha_22092009": (
        "long_term_reversal",
        "s = ts_sum(delay(log1p(only(returns > R_min, isfinite(returns))), N_skip), N_rev); Q_center - (avgrank(s) - Q_center) / xcount(s)",
        {"N_rev": 252, "N_skip": 21, "Q_center": 0.5, "R_min": -1},
    ),
    "alpha_283a89f6": (
        "liquidity",
        "x = only(close > 0, isfinite(close)) * only(volume >= 0, isfinite(volume)); b = ts_median(delay(x, 1), N_liq); v = stddev(isfinite(delay(returns, 1)), N_risk);"
        "ts_mean(-1 * clip(isfinite(returns) / only(v > 0, v), -Z_cap, Z_cap) * emax(1 - x / only(b > 0, b), 0), N_smooth)",
        {"N_liq": 20, "N_risk": 20, "N_smooth": 3, "Z_cap": 5},
    ),
    "alpha_3205f951": (
        "short_term_reversal",
        "l = delay(close, N_rev); s = stddev_pop(returns, N_vol); v = ts_median(volume, N_volume); r = volume / v;"
        "x = only((close > 0) * (l > 0) * (volume >= 0) * (v > volume_floor) * (s > sigma_floor) * ((log_offset + r) > 0), -1 * (close / l - 1) / (s * sqrt(N_rev)) * log(log_offset + r));"
        "rank(least_names(x, N_cs_min)) - rank_center",
        {"N_rev": 3, "N_vol": 20, "N_volume": 20, "sigma_floor": 1e-6, "volume_floor": 0, "log_offset": 1, "rank_center": 0.5, "N_cs_min": 30},
    ),
    "alpha_531b4df4": (
        "short_term_reversal",
        "l = delay(close, N_rev); q = sqrt(ts_mean(returns * returns, N_risk)); a = ts_mean(volume, N_volume);"
        "rank_centered(isfinite(only((close > 0) * (l > 0) * (volume >= 0) * (a > 0) * (q > 0), (close / l - 1) / q * log1p(volume / a) * -1)), N_cs_min)",
        {"N_rev": 3, "N_risk": 20, "N_volume": 20, "N_cs_min": 20},
    ),
    "alpha_53dc361e": (
        "trading_volume",
        "p = delay(log(volume), 1); s = stddev(p, N_vol); w = high - low;"
        "rank_centered(emax((log(volume) - ts_mean(p, N_vol)) / only(s > 0, s) - Z_threshold, 0) * (((close - low) - (high - close)) / only(w > 0, w)), N_xs)",
        {"N_vol": 20, "Z_threshold": 0.5, "N_xs": 20},
    ),
    "alpha_6469c6c8": (
        "momentum",
        "p = delay(log1p(only(returns > -1, isfinite(returns))), K_skip); m = ts_sum(p, N_mom); v = stddev(p, N_mom); l = ts_sum(abs(p), N_mom);"
        "s = ts_mean(only((v > 0) * (l > 0), isfinite(m / (v * sqrt(N_mom)) * abs(m) / l)), N_smooth);"
        "least_names(2 * (avgrank(s) - (xcount(s) + 1) / 2) / (xcount(s) - 1), N_xs_min)",
        {"N_mom": 60, "K_skip": 5, "N_smooth": 5, "N_xs_min": 20},
    ),
    "alpha_892decf0": (
        "long_term_reversal",
        "a = delay(close, N_long); b = delay(close, N_skip); r = rank(only((a > 0) * (b > 0), b / a - 1)); least_names(xmean(r) - r, N_cs_min)",
        {"N_long": 252, "N_skip": 21, "N_cs_min": 2},
    ),
    "alpha_8c81a59b": ("nearness_to_the_52_week_high", "h = ts_max(high, N_high); rank_centered(ts_mean(only(abs(h) > 0, close / h), N_smooth), 2)", {"N_high": 252, "N_smooth": 5}),
    "alpha_94d09c91": ("nearness_to_the_52_week_high", "h = ts_max(high, N_high); demean(rank(ts_mean(close / only(abs(h) > 0, h), N_smooth)))", {"N_high": 252, "N_smooth": 5}),
    "alpha_a3d1a1d6": (
        "beta",
        "r = isfinite(returns); m = xmean(r, N_market_min); x = r + m * 0; y = m + r * 0; n = ts_count(x, N_beta);"
        "cov = sum_min(x * y, N_beta, N_min) - sum_min(x, N_beta, N_min) * sum_min(y, N_beta, N_min) / n;"
        "v = sum_min(y * y, N_beta, N_min) - sum_min(y, N_beta, N_min) * sum_min(y, N_beta, N_min) / n; b = only(n >= N_min, cov / only(v > 0, v));"
        "least_names(demean(rank(-b)), N_cs_min)",
        {"N_beta": 60, "N_min": 40, "N_market_min": 50, "N_cs_min": 50},
    ),
    "alpha_aad8537f": ("nearness_to_the_52_week_high", "h = ts_max(high, N_high); demean(rank(ts_mean(close / only(h > 0, h), N_smooth)))", {"N_high": 252, "N_smooth": 5}),
    "alpha_ab4bc903": (
        "long_term_reversal",
        "c = delay(close, 1); p = delay(isfinite(close / only(abs(c) > 0, c) - 1), N_skip); q = sqrt(ts_mean(p * p, N_form)); demean(rank(-(ts_mean(p, N_form) / only(abs(q) > 0, q))))",
        {"N_form": 231, "N_skip": 21},
    ),
    "alpha_ada96f52": (
        "liquidity",
        "d = only(close * volume > 0, close * volume); b = ts_mean(delay(abs(returns) / d, 1), N_base); least_names(-demean(rank(ts_mean(returns / d / only(b > 0, b), N_smooth))), N_xs)",
        {"N_base": 20, "N_smooth": 3, "N_xs": 50},
    ),
    "alpha_b959ae38": (
        "volatility",
        "c = delay(close, 1); t = rowmax(high - low, abs(high - c), abs(low - c)) + 0 * (open + high + low + close); a = ts_mean(delay(t, 1), N_vol);"
        "demean(rank(ts_mean(only(t > V_floor, (close - open) / t) * emax(only(a > V_floor, t / a) - theta_expand, E_floor), N_smooth)))",
        {"N_vol": 20, "N_smooth": 3, "theta_expand": 1.25, "V_floor": 0, "E_floor": 0},
    ),
    "alpha_c76f01a4": (
        "beta",
        "m = xmean(returns, N_mkt); x = returns + m * 0; y = m + returns * 0; v = ts_sum(y * y, N_beta) - ts_sum(y, N_beta) * ts_sum(y, N_beta) / N_beta;"
        "b = (ts_sum(x * y, N_beta) - ts_sum(x, N_beta) * ts_sum(y, N_beta) / N_beta) / only(v > 0, v); -rank_centered(b * market_sum(m, N_shock), N_xs)",
        {"N_beta": 60, "N_shock": 5, "N_mkt": 20, "N_xs": 20},
    ),
    "alpha_c7a0b99f": (
        "momentum",
        "a = delay(close, N_skip); b = delay(close, N_skip + N_mom); k = stddev(returns, N_risk); v = ts_mean(volume, N_volume);"
        "x = log(only(a > 0, a) / only(b > 0, b)) / only(k > 0, k) * (1 + beta_volume * tanh(log(only(volume > 0, volume) / only(v > 0, v)))); isfinite(rank_centered(isfinite(x), N_cs_min))",
        {"N_mom": 60, "N_skip": 5, "N_risk": 20, "N_volume": 20, "beta_volume": 0.5, "N_cs_min": 20},
    ),
    "alpha_cd223ad6": (
        "volatility",
        "w = only(close > 0, (high - low) / close); p = delay(returns, 1); v = sqrt(ts_mean(p * p, N_vol)); a = ts_mean(delay(w, 1), N_range);"
        "rank_centered(only((v > 0) * (a > 0), -returns / v * w / a), 2)",
        {"N_vol": 20, "N_range": 20},
    ),
    "alpha_cee44e99": (
        "volatility",
        "r = isfinite(returns); w = only((close > 0) * (high >= low), isfinite((high - low) / close)); p = delay(r, 1); v = sqrt(ts_mean(p * p, N_vol)); a = ts_mean(delay(w, 1), N_range);"
        "-clip(r / only(v > sigma_floor, v), -Z_cap, Z_cap) * emax(emin(w / only(a > 0, a), E_cap) - theta_expand, 0)",
        {"N_vol": 20, "N_range": 20, "sigma_floor": 1e-8, "Z_cap": 5, "E_cap": 3, "theta_expand": 1},
    ),
    "alpha_d34474c5": (
        "liquidity",
        "r = isfinite(returns); i = isfinite(abs(r) / only((close > 0) * (volume > 0), close * volume)); x = isfinite(-r * isfinite(i / ts_mean(delay(i, 1), N_liq)));"
        "least_names(alpha_scale * ((avgrank(x) - 1) / (xcount(x) - 1) - rank_center), N_cs)",
        {"N_liq": 20, "N_cs": 20, "rank_center": 0.5, "alpha_scale": 2},
    ),
    "alpha_de867dae": (
        "trading_volume",
        "s = stddev_pop(volume, N_vol); w = high - low;"
        "demean(rank(emax((volume - ts_mean(volume, N_vol)) / only(abs(s) > 0, s), Z_floor) * ((K_clv * close - high - low) / only(abs(w) > 0, w))))",
        {"N_vol": 20, "Z_floor": 0, "K_clv": 2},
    ),
    "alpha_f84c3338": (
        "trading_volume",
        "v = log(volume); s = stddev(v, N_vol); l = delay(close, N_ret); x = emax(only(s > 0, (v - ts_mean(v, N_vol)) / s) - Z_threshold, 0);"
        "ts_mean(-(only(close > 0, close) / only(l > 0, l) - 1) * x, N_hold)",
        {"N_ret": 5, "N_vol": 20, "Z_threshold": 1, "N_hold": 3},
    ),
    "alpha_fc30ce60": (
        "beta",
        "m = xmean(returns, N_market_min); x = returns + m * 0; y = m + returns * 0; a = mean_min(y, N_beta, M_beta); v = mean_min(y * y, N_beta, M_beta) - a * a;"
        "b = (mean_min(x * y, N_beta, M_beta) - mean_min(x, N_beta, M_beta) * a) / only(v > epsilon_var, v); zscore_pop(-b * m, N_cs_min, epsilon_cs)",
        {"N_beta": 60, "M_beta": 40, "N_market_min": 2, "N_cs_min": 2, "epsilon_var": 1e-12, "epsilon_cs": 1e-12},
    ),
}


def artifact(name: str, **params: float) -> Node:
    """An artifact's signal. Raises for a failed call and for windows that can't be."""
    _, text, defaults = ARTIFACTS[name]
    if text is None:
        raise ValueError(f"{name} has no formula: its call failed")
    if unknown := set(params) - set(defaults):
        raise ValueError(f"{name} has no parameter {sorted(unknown)}")
    return parse(text, **(defaults | params))


def artifacts() -> tuple[dict[str, Node], dict[str, str]]:
    """All signals that can be built, and the messages of those that can't: one bad formula doesn't stop the rest."""
    built, failed = {}, {}
    for name in ARTIFACTS:
        try:
            built[name] = artifact(name)
        except ValueError as e:
            failed[name] = str(e)
    return built, failed
