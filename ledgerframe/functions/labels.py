"""Fixed label values and thresholds of the reports.

These strings and edges must equal the original reports' literals for
results to match, so they are stated here plainly, in the order the
reports use them. Callers may pass their own label sets to operators.
"""

# --- fixed values: debit amount bands (first matching band wins) ---
DEBIT_BANDS = [
    # (label, lower bound inclusive or None, upper bound or None, upper inclusive)
    ("0-100", None, 100, False),
    ("100-500", 100, 500, True),
    ("500-1000", 500, 1000, True),
    ("1000-5000", 1000, 5000, True),
    ("5000+", 5000, None, False),
]
NO_DEBIT_LABEL = "No debit"

# --- fixed values: risk amount bands (debit strictly above the edge) ---
RISK_AMOUNT_BANDS = [
    ("Крупные (>100k)", 100000),
    ("Средние (50k-100k)", 50000),
    ("Малые (10k-50k)", 10000),
]
RISK_AMOUNT_ELSE = "Микро (<10k)"

# --- fixed values: risk level by rounded flagged percentage (strictly above) ---
RISK_LEVELS = [
    ("КРИТИЧЕСКИЙ РИСК", 10),
    ("ВЫСОКИЙ РИСК", 5),
    ("СРЕДНИЙ РИСК", 2),
]
RISK_LEVEL_ELSE = "НИЗКИЙ РИСК"

# --- fixed values: RFM segment by total score (inclusive ranges) ---
RFM_SEGMENTS = [
    ("VIP категории", 13, None),
    ("Популярные", 10, 12),
    ("Обычные", 7, 9),
    ("Редкие", 4, 6),
]
RFM_SEGMENT_ELSE = "Неактивные"

# --- fixed values: RFM risk by rounded flagged percentage (strictly above) ---
RFM_RISK = [
    ("Высокорисковые", 10),
    ("Среднерисковые", 5),
]
RFM_RISK_ELSE = "Низкорисковые"

# --- fixed values: category mart segments (strictly above) ---
VALUE_SEGMENTS = [("HIGH VALUE", 1000000), ("MEDIUM VALUE", 100000)]
VALUE_SEGMENT_ELSE = "LOW VALUE"
FREQUENCY_SEGMENTS = [("VERY FREQUENT", 100), ("FREQUENT", 50), ("REGULAR", 10)]
FREQUENCY_SEGMENT_ELSE = "RARE"
# flagged share (unrounded fraction, not percent), strictly above
RISK_SEGMENTS = [("HIGH RISK", "0.1"), ("MEDIUM RISK", "0.05")]
RISK_SEGMENT_ELSE = "LOW RISK"

# --- fixed values: anomaly label by flagged count vs rounded 7-row mean ---
ANOMALY_CRITICAL = "КРИТИЧЕСКАЯ АНОМАЛИЯ"
ANOMALY = "АНОМАЛИЯ"
ANOMALY_LOW = "НИЗКАЯ АКТИВНОСТЬ"
ANOMALY_NORMAL = "НОРМА"
ANOMALY_RULES = [(ANOMALY_CRITICAL, ">", "2"), (ANOMALY, ">", "1.5"), (ANOMALY_LOW, "<", "0.5")]
ANOMALY_LABELS = [ANOMALY_CRITICAL, ANOMALY]  # days worth investigating
ANOMALY_PATTERN = "%АНОМАЛИЯ%"  # LIKE pattern counting anomaly days

# --- fixed values: KPI long form (group, name, unit) in report order ---
KPI_GROUP = "ОБЩИЕ ПОКАЗАТЕЛИ"
KPI_ROWS = [
    ("Всего транзакций", ""),
    ("Уникальных категорий", ""),
    ("Активных дней", ""),
    ("Период", ""),
    ("Общий дебет", "руб"),
    ("Общий кредит", "руб"),
    ("Средний дебет", "руб"),
    ("Средний кредит", "руб"),
    ("Подозрительных транзакций", ""),
    ("Доля подозрительных", "%"),
]
PERIOD_SEPARATOR = " - "

# --- fixed values: thresholds ---
HIGH_RISK_DAY_RATE = 10  # rounded percentage, strictly above
LARGE_MULTIPLIER = 2  # rounded multiplier, strictly above
LARGE_DEBIT = 100000  # flagged rows with debit strictly above
BIG_CATEGORY_VOLUME = 100000000  # debit+credit volume strictly above

# --- fixed values: table and column documentation of the marts and fact table ---
FACT_TABLE_COMMENT = "Факты транзакций из Kaggle датасета"
FACT_COLUMN_COMMENTS = {
    "is_suspicious": "Флаг подозрительности: 0 - норма, 1 - подозрительно",
}
DAILY_MART_COMMENT = "Ежедневная витрина транзакций для дашбордов"
DAILY_MART_COLUMN_COMMENTS = {
    "transactions_ma7": "Скользящее среднее за 7 дней",
    "suspicious_rate": "Процент подозрительных транзакций",
}
ANOMALY_MART_COMMENT = "Витрина для анализа подозрительных транзакций и аномалий"
ANOMALY_MART_COLUMN_COMMENTS = {
    "anomaly_flag": "Флаг аномалии на основе отклонения от скользящего среднего",
    "suspicious_debit_multiplier": "Во сколько раз подозрительные транзакции крупнее нормальных",
}
