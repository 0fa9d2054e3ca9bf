"""Fixed code values the jobs depend on.

FIXED VALUES — these must stay as written; the jobs compare against them.
  Dictionary parent codes: 10 order status, 11 payment type, 12 appraise,
  13 refund reason, 15 refund type, 16 payment status, 24 source type,
  31 activity type, 32 coupon type, 33 coupon range, 07 refund status.
  Order status: 1001 unpaid, 1002 paid, 1003 cancelled, 1004 finished,
  1005 refund requested, 1006 refund done.
  Payment status paid: 1602.  Refund status completed: 0705.
  Benefit text (coupon 3201/3202/3203, activity 3101/3102/3103):
    '满' amount '元减' benefit '元'   (full reduction)
    '满' num '件打' 10*(1-discount) '折'   (full discount)
    '减' benefit '元'   (coupon cash)   /   '打' 10*(1-discount) '折'  (activity discount)
  Report periods: 1, 7, 30 days.  Open SCD2 partition: 9999-12-31.
  Local time zone of the app logs: GMT+8.
"""

ORDER_UNPAID, ORDER_PAID, ORDER_CANCELLED = "1001", "1002", "1003"
ORDER_REFUND_ASKED, ORDER_REFUND_DONE = "1005", "1006"
PAYMENT_PAID = "1602"
REFUND_DONE = "0705"
OPEN_END = "9999-12-31"
LOCAL_TZ = "GMT+8"
PERIODS = (1, 7, 30)
TRAILING = (7, 30)

# (dic_code, dic_name, parent_code) — the dictionary the decode joins read.
DICTIONARY = [
    ("1001", "unpaid", "10"), ("1002", "paid", "10"), ("1003", "cancelled", "10"),
    ("1004", "finished", "10"), ("1005", "refund requested", "10"), ("1006", "refund done", "10"),
    ("1101", "alipay", "11"), ("1102", "wechat", "11"), ("1103", "unionpay", "11"),
    ("1104", "card", "11"), ("1105", "cash", "11"),
    ("1201", "good", "12"), ("1202", "medium", "12"), ("1203", "bad", "12"), ("1204", "auto", "12"),
    ("1301", "quality", "13"), ("1302", "wrong item", "13"), ("1303", "changed mind", "13"),
    ("1304", "out of stock", "13"), ("1305", "late delivery", "13"), ("1306", "damaged", "13"),
    ("1307", "other", "13"),
    ("1501", "refund only", "15"), ("1502", "return and refund", "15"),
    ("1601", "unpaid", "16"), ("1602", "paid", "16"),
    ("2401", "search", "24"), ("2402", "promotion", "24"), ("2403", "recommendation", "24"),
    ("2404", "activity", "24"),
    ("3101", "full reduction", "31"), ("3102", "full discount", "31"), ("3103", "item discount", "31"),
    ("3201", "full reduction", "32"), ("3202", "full discount", "32"), ("3203", "cash", "32"),
    ("3301", "category", "33"), ("3302", "brand", "33"), ("3303", "spu", "33"),
    ("0701", "requested", "07"), ("0705", "completed", "07"),
]
