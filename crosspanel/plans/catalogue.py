"""Formula catalogues: published control formulas, leak-test bases, and forms found in generated artifacts.

The published formulas' texts and default parameters are fixed values; window lengths are floored when they are parsed.
"""

from __future__ import annotations

from .compiler import neutral
from .expr import Node, parse

# 50 published formulas that need prices, volume and returns only, with their default parameters.
CONTROLS: dict[str, tuple[str, dict[str, float]]] = {
    "k001": ("rank(ts_argmax(signedpower(where(returns < 0, stddev(returns, d_std), close), 2), d_arg)) - 0.5", {"d_std": 20, "d_arg": 5}),
    "k002": ("-1 * correlation(rank(delta(log(volume), d_delta)), rank((close - open) / open), d_corr)", {"d_delta": 2, "d_corr": 6}),
    "k003": ("-1 * correlation(rank(open), rank(volume), d_corr)", {"d_corr": 10}),
    "k004": ("-1 * ts_rank(rank(low), d_rank)", {"d_rank": 9}),
    "k006": ("-1 * correlation(open, volume, d_corr)", {"d_corr": 10}),
    "k007": ("where(adv(d_adv) < volume, (-1 * ts_rank(abs(delta(close, d_delta)), d_rank)) * sign(delta(close, d_delta)), -1)", {"d_adv": 20, "d_delta": 7, "d_rank": 60}),
    "k008": ("-1 * rank(ts_sum(open, d_sum) * ts_sum(returns, d_sum) - delay(ts_sum(open, d_sum) * ts_sum(returns, d_sum), d_delay))", {"d_sum": 5, "d_delay": 10}),
    "k009": ("where(ts_min(delta(close, 1), d_window) > 0, delta(close, 1), where(ts_max(delta(close, 1), d_window) < 0, delta(close, 1), -1 * delta(close, 1)))", {"d_window": 5}),
    "k010": ("rank(where(ts_min(delta(close, 1), d_window) > 0, delta(close, 1), where(ts_max(delta(close, 1), d_window) < 0, delta(close, 1), -1 * delta(close, 1))))", {"d_window": 4}),
    "k012": ("sign(delta(volume, 1)) * (-1 * delta(close, 1))", {}),
    "k013": ("-1 * rank(covariance(rank(close), rank(volume), d_cov))", {"d_cov": 5}),
    "k014": ("(-1 * rank(delta(returns, d_delta))) * correlation(open, volume, d_corr)", {"d_delta": 3, "d_corr": 10}),
    "k015": ("-1 * ts_sum(rank(correlation(rank(high), rank(volume), d_corr)), d_sum)", {"d_corr": 3, "d_sum": 3}),
    "k016": ("-1 * rank(covariance(rank(high), rank(volume), d_cov))", {"d_cov": 5}),
    "k017": ("((-1 * rank(ts_rank(close, d_tsr_close))) * rank(delta(delta(close, 1), 1))) * rank(ts_rank(volume / adv(d_adv), d_tsr_vol))", {"d_tsr_close": 10, "d_adv": 20, "d_tsr_vol": 5}),
    "k018": ("-1 * rank((stddev(abs(close - open), d_std) + (close - open)) + correlation(close, open, d_corr))", {"d_std": 5, "d_corr": 10}),
    "k019": ("(-1 * sign((close - delay(close, d_delay)) + delta(close, d_delay))) * (1 + rank(1 + ts_sum(returns, d_sum)))", {"d_delay": 7, "d_sum": 250}),
    "k020": ("((-1 * rank(open - delay(high, d_delay))) * rank(open - delay(close, d_delay))) * rank(open - delay(low, d_delay))", {"d_delay": 1}),
    "k021": ("where(ts_sum(close, d_long) / d_long + stddev(close, d_long) < ts_sum(close, d_short) / d_short, -1, where(ts_sum(close, d_short) / d_short < ts_sum(close, d_long) / d_long - stddev(close, d_long), 1, where(volume / adv(d_adv) >= 1, 1, -1)))", {"d_long": 8, "d_short": 2, "d_adv": 20}),
    "k022": ("-1 * (delta(correlation(high, volume, d_corr), d_delta) * rank(stddev(close, d_std)))", {"d_corr": 5, "d_delta": 5, "d_std": 20}),
    "k023": ("where(ts_sum(high, d_mean) / d_mean < high, -1 * delta(high, d_delta), 0)", {"d_mean": 20, "d_delta": 2}),
    "k024": ("where(delta(ts_sum(close, d_long) / d_long, d_long) / delay(close, d_long) <= k, -1 * (close - ts_min(close, d_long)), -1 * delta(close, d_delta))", {"d_long": 100, "d_delta": 3, "k": 0.05}),
    "k026": ("-1 * ts_max(correlation(ts_rank(volume, d_tsr), ts_rank(high, d_tsr), d_corr), d_max)", {"d_tsr": 5, "d_corr": 5, "d_max": 3}),
    "k028": ("scale((correlation(adv(d_adv), low, d_corr) + (high + low) / 2) - close)", {"d_adv": 20, "d_corr": 5}),
    "k029": ("ts_min(product(rank(rank(scale(log(ts_sum(ts_min(rank(rank(-1 * rank(delta(close - 1, d_delta)))), d_min), d_sum))))), d_prod), d_tsmin) + ts_rank(delay(-1 * returns, d_delay), d_tsr)", {"d_delta": 5, "d_min": 2, "d_sum": 1, "d_prod": 1, "d_tsmin": 5, "d_delay": 6, "d_tsr": 5}),
    "k030": ("((1 - rank((sign(close - delay(close, 1)) + sign(delay(close, 1) - delay(close, 2))) + sign(delay(close, 2) - delay(close, 3)))) * ts_sum(volume, d_short)) / ts_sum(volume, d_long)", {"d_short": 5, "d_long": 20}),
    "k031": ("(rank(rank(rank(decay_linear(-1 * rank(rank(delta(close, d_delta_long))), d_decay)))) + rank(-1 * delta(close, d_delta_short))) + sign(scale(correlation(adv(d_adv), low, d_corr)))", {"d_delta_long": 10, "d_decay": 10, "d_delta_short": 3, "d_adv": 20, "d_corr": 12}),
    "k033": ("rank(-1 * (1 - open / close))", {}),
    "k034": ("rank((1 - rank(stddev(returns, d_short) / stddev(returns, d_long))) + (1 - rank(delta(close, 1))))", {"d_short": 2, "d_long": 5}),
    "k035": ("(ts_rank(volume, d_vol) * (1 - ts_rank((close + high) - low, d_price))) * (1 - ts_rank(returns, d_ret))", {"d_vol": 32, "d_price": 16, "d_ret": 32}),
    "k037": ("rank(correlation(delay(open - close, d_delay), close, d_corr)) + rank(open - close)", {"d_corr": 200, "d_delay": 1}),
    "k038": ("(-1 * rank(ts_rank(close, d_tsr))) * rank(close / open)", {"d_tsr": 10}),
    "k039": ("(-1 * rank(delta(close, d_delta) * (1 - rank(decay_linear(volume / adv(d_adv), d_decay))))) * (1 + rank(ts_sum(returns, d_sum)))", {"d_delta": 7, "d_decay": 9, "d_adv": 20, "d_sum": 250}),
    "k040": ("(-1 * rank(stddev(high, d_std))) * correlation(high, volume, d_corr)", {"d_std": 10, "d_corr": 10}),
    "k043": ("ts_rank(volume / adv(d_adv), d_tsr_vol) * ts_rank(-1 * delta(close, d_delta), d_tsr_px)", {"d_adv": 20, "d_tsr_vol": 20, "d_delta": 7, "d_tsr_px": 8}),
    "k044": ("-1 * correlation(high, rank(volume), d_corr)", {"d_corr": 5}),
    "k045": ("-1 * ((rank(ts_sum(delay(close, d_delay), d_mean) / d_mean) * correlation(close, volume, d_corr)) * rank(correlation(ts_sum(close, d_short), ts_sum(close, d_long), d_corr)))", {"d_delay": 5, "d_mean": 20, "d_corr": 2, "d_short": 5, "d_long": 20}),
    "k046": ("where((delay(close, d_far) - delay(close, d_near)) / d_near - (delay(close, d_near) - close) / d_near > k, -1, where((delay(close, d_far) - delay(close, d_near)) / d_near - (delay(close, d_near) - close) / d_near < 0, 1, -1 * (close - delay(close, 1))))", {"d_far": 20, "d_near": 10, "k": 0.25}),
    "k049": ("where((delay(close, d_far) - delay(close, d_near)) / d_near - (delay(close, d_near) - close) / d_near < k, 1, -1 * (close - delay(close, 1)))", {"d_far": 20, "d_near": 10, "k": -0.1}),
    "k051": ("where((delay(close, d_far) - delay(close, d_near)) / d_near - (delay(close, d_near) - close) / d_near < k, 1, -1 * (close - delay(close, 1)))", {"d_far": 20, "d_near": 10, "k": -0.05}),
    "k052": ("(((-1 * ts_min(low, d_min)) + delay(ts_min(low, d_min), d_delay)) * rank((ts_sum(returns, d_long) - ts_sum(returns, d_short)) / (d_long - d_short))) * ts_rank(volume, d_tsr)", {"d_min": 5, "d_delay": 5, "d_long": 240, "d_short": 20, "d_tsr": 5}),
    "k055": ("-1 * correlation(rank((close - ts_min(low, d_window)) / (ts_max(high, d_window) - ts_min(low, d_window))), rank(volume), d_corr)", {"d_window": 12, "d_corr": 6}),
    "k060": ("0 - 1 * (2 * scale(rank((((close - low) - (high - close)) / (high - low)) * volume)) - scale(rank(ts_argmax(close, d_arg))))", {"d_arg": 10}),
    "k068": ("(ts_rank(correlation(rank(high), rank(adv(d_adv)), d_corr), d_tsr) < rank(delta(close * w + low * (1 - w), d_delta))) * -1", {"d_adv": 15, "d_corr": 8.91644, "d_tsr": 13.9333, "w": 0.518371, "d_delta": 1.06157}),
    "k085": ("power(rank(correlation(high * w + close * (1 - w), adv(d_adv), d_corr1)), rank(correlation(ts_rank((high + low) / 2, d_tsr_px), ts_rank(volume, d_tsr_vol), d_corr2)))", {"w": 0.876703, "d_adv": 30, "d_corr1": 9.61331, "d_tsr_px": 3.70596, "d_tsr_vol": 10.1595, "d_corr2": 7.11408}),
    "k088": ("emin(rank(decay_linear((rank(open) + rank(low)) - (rank(high) + rank(close)), d_decay1)), ts_rank(decay_linear(correlation(ts_rank(close, d_tsr_close), ts_rank(adv(d_adv), d_tsr_adv), d_corr), d_decay2), d_tsr_out))", {"d_decay1": 8.06882, "d_tsr_close": 8.44728, "d_adv": 60, "d_tsr_adv": 20.6966, "d_corr": 8.01266, "d_decay2": 6.65053, "d_tsr_out": 2.61957}),
    "k092": ("emin(ts_rank(decay_linear((high + low) / 2 + close < low + open, d_decay1), d_tsr1), ts_rank(decay_linear(correlation(rank(low), rank(adv(d_adv)), d_corr), d_decay2), d_tsr2))", {"d_decay1": 14.7221, "d_tsr1": 18.8683, "d_adv": 30, "d_corr": 7.58555, "d_decay2": 6.94024, "d_tsr2": 6.80584}),
    "k095": ("rank(open - ts_min(open, d_min)) < ts_rank(power(rank(correlation(ts_sum((high + low) / 2, d_sum), ts_sum(adv(d_adv), d_sum), d_corr)), p), d_tsr)", {"d_min": 12.4105, "d_sum": 19.1351, "d_adv": 40, "d_corr": 12.8742, "d_tsr": 11.7584, "p": 5}),
    "k099": ("(rank(correlation(ts_sum((high + low) / 2, d_sum), ts_sum(adv(d_adv), d_sum), d_corr1)) < rank(correlation(low, volume, d_corr2))) * -1", {"d_sum": 19.8975, "d_adv": 60, "d_corr1": 8.8136, "d_corr2": 6.28259}),
    "k101": ("(close - open) / ((high - low) + eps)", {"eps": 0.001}),
}
# Eight row-axis bases of the leak test.
BASES: dict[str, str] = {
    "momentum": "delay(close, 21) / delay(close, 252) - 1",
    "short_term_reversal": "-1 * (close / delay(close, 5) - 1)",
    "volatility": "-1 * stddev(returns, 20)",
    "liquidity": "-1 * ts_mean(abs(returns) / where(abs(close * volume) > 0, close * volume, 0 / 0), 20)",
    "trading_volume": "-1 * (volume / ts_mean(volume, 20))",
    "nearness_to_the_52_week_high": "close / ts_max(close, 252)",
    "long_term_reversal": "-1 * (delay(close, 252) / delay(close, 756) - 1)",
    "beta": "-1 * ((ts_mean(returns * xmean(returns), 120) - ts_mean(returns, 120) * ts_mean(xmean(returns), 120)) / ts_var(xmean(returns), 120))",
}
#: Leak weights and replicates; the base of replicate i is the i-th, cyclically.
LEAK_WEIGHTS, LEAK_REPLICATES = (0.02, 0.04, 0.06, 0.08, 0.10, 0.15, 0.20), 8


def control(name: str, **params: float) -> Node:
    """A published formula as text says, before its final form."""
    text, defaults = CONTROLS[name]
    if unknown := set(params) - set(defaults) - {"adv_dollar"}:
        raise ValueError(f"{name} has no parameter {sorted(unknown)}")
    return parse(text, **(defaults | params))


def control_signal(name: str, min_names: int = 20, neutralize: bool = True, **params: float) -> Node:
    return neutral(control(name, **params), min_names, neutralize)
