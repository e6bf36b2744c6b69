"""Indicator periods."""

# Indicator periods in use.
PERIODS = {
    "rsi": 42, "roc": 60, "mtm": 40, "cmo": 42, "stochrsi": 28, "rvi": 14,
    "macd_fast": 25, "macd_slow": 90, "macd_signal": 20, "adx": 35, "dmi": 35, "aroon": 50, "trix": 30,
    "ma_ratio": 120, "ma_slope": 30, "atr": 30, "natr": 28, "bb": 100, "bb_std": 1.5, "cci": 35, "ulcer": 35,
    "price_var": 30, "vol_ma": 5, "vol_std": 10, "amt_ma": 5, "amt_std": 10, "mfi": 35, "vr": 52, "vroc": 36,
    "vrsi": 21, "vmacd_fast": 25, "vmacd_slow": 60, "vmacd_signal": 20, "adosc_fast": 3, "adosc_slow": 7,
    "kdj": 28, "willr": 35, "bias": 36, "psy": 30, "ar_br": 52, "cr": 52,
}
