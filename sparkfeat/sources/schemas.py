"""File names and column types of the eight loan-history tables.

A table may lack columns and may hold others; the reader infers the types of the others.
"""

from __future__ import annotations

# File names, column names and types of the input tables.
TABLE_FILES = {
    "application_train": "application_train.csv",
    "application_test": "application_test.csv",
    "bureau": "bureau.csv",
    "bureau_balance": "bureau_balance.csv",
    "previous_application": "previous_application.csv",
    "pos_cash_balance": "POS_CASH_balance.csv",
    "installments_payments": "installments_payments.csv",
    "credit_card_balance": "credit_card_balance.csv",
}

_APPLICATION = {
    "bigint": "SK_ID_CURR",
    "int": """
        DAYS_BIRTH DAYS_EMPLOYED CNT_CHILDREN FLAG_MOBIL FLAG_EMP_PHONE FLAG_CONT_MOBILE FLAG_EMAIL
        FLAG_DOCUMENT_2 FLAG_DOCUMENT_4 FLAG_DOCUMENT_5 FLAG_DOCUMENT_6 FLAG_DOCUMENT_7
        FLAG_DOCUMENT_9 FLAG_DOCUMENT_10 FLAG_DOCUMENT_11 FLAG_DOCUMENT_12 FLAG_DOCUMENT_13
        FLAG_DOCUMENT_14 FLAG_DOCUMENT_15 FLAG_DOCUMENT_16 FLAG_DOCUMENT_17 FLAG_DOCUMENT_19
        FLAG_DOCUMENT_20 FLAG_DOCUMENT_21 REG_CITY_NOT_WORK_CITY REG_REGION_NOT_LIVE_REGION
        REG_REGION_NOT_WORK_REGION LIVE_REGION_NOT_WORK_REGION
    """,
    "double": """
        AMT_INCOME_TOTAL AMT_CREDIT AMT_ANNUITY AMT_GOODS_PRICE AMT_REQ_CREDIT_BUREAU_HOUR
        AMT_REQ_CREDIT_BUREAU_DAY AMT_REQ_CREDIT_BUREAU_WEEK AMT_REQ_CREDIT_BUREAU_QRT
        OBS_30_CNT_SOCIAL_CIRCLE DAYS_LAST_PHONE_CHANGE OWN_CAR_AGE CNT_FAM_MEMBERS EXT_SOURCE_1
        EXT_SOURCE_2 EXT_SOURCE_3 ELEVATORS_MEDI ELEVATORS_MODE ENTRANCES_MODE FLOORSMAX_MODE
    """,
    "string": """
        CODE_GENDER ORGANIZATION_TYPE FLAG_OWN_CAR NAME_CONTRACT_TYPE NAME_EDUCATION_TYPE
        NAME_FAMILY_STATUS NAME_HOUSING_TYPE NAME_INCOME_TYPE NAME_TYPE_SUITE OCCUPATION_TYPE
        WEEKDAY_APPR_PROCESS_START EMERGENCYSTATE_MODE FONDKAPREMONT_MODE HOUSETYPE_MODE
        WALLSMATERIAL_MODE
    """,
}

TABLE_TYPES = {
    "application_train": {**_APPLICATION, "int": f"TARGET {_APPLICATION['int']}"},
    "application_test": _APPLICATION,
    "bureau": {
        "bigint": "SK_ID_CURR SK_ID_BUREAU",
        "int": "DAYS_CREDIT DAYS_CREDIT_UPDATE CREDIT_DAY_OVERDUE CNT_CREDIT_PROLONG",
        "double": """
            DAYS_CREDIT_ENDDATE AMT_CREDIT_MAX_OVERDUE AMT_CREDIT_SUM AMT_CREDIT_SUM_DEBT
            AMT_CREDIT_SUM_LIMIT AMT_CREDIT_SUM_OVERDUE AMT_ANNUITY
        """,
        "string": "CREDIT_ACTIVE CREDIT_CURRENCY CREDIT_TYPE",
    },
    "bureau_balance": {"bigint": "SK_ID_BUREAU", "int": "MONTHS_BALANCE", "string": "STATUS"},
    "previous_application": {
        "bigint": "SK_ID_PREV SK_ID_CURR",
        "int": "HOUR_APPR_PROCESS_START DAYS_DECISION",
        "double": """
            AMT_ANNUITY AMT_APPLICATION AMT_CREDIT AMT_DOWN_PAYMENT AMT_GOODS_PRICE
            RATE_DOWN_PAYMENT CNT_PAYMENT DAYS_FIRST_DRAWING DAYS_FIRST_DUE
            DAYS_LAST_DUE_1ST_VERSION DAYS_LAST_DUE DAYS_TERMINATION
        """,
        "string": """
            NAME_CONTRACT_STATUS NAME_CONTRACT_TYPE CHANNEL_TYPE CODE_REJECT_REASON
            FLAG_LAST_APPL_PER_CONTRACT NAME_CASH_LOAN_PURPOSE NAME_CLIENT_TYPE
            NAME_GOODS_CATEGORY NAME_PAYMENT_TYPE NAME_PORTFOLIO NAME_PRODUCT_TYPE
            NAME_SELLER_INDUSTRY NAME_TYPE_SUITE NAME_YIELD_GROUP PRODUCT_COMBINATION
            WEEKDAY_APPR_PROCESS_START
        """,
    },
    "pos_cash_balance": {
        "bigint": "SK_ID_PREV SK_ID_CURR",
        "int": "MONTHS_BALANCE SK_DPD SK_DPD_DEF",
        "string": "NAME_CONTRACT_STATUS",
    },
    "installments_payments": {
        "bigint": "SK_ID_PREV SK_ID_CURR",
        "double": """
            AMT_PAYMENT AMT_INSTALMENT DAYS_ENTRY_PAYMENT DAYS_INSTALMENT NUM_INSTALMENT_VERSION
        """,
    },
    "credit_card_balance": {
        "bigint": "SK_ID_PREV SK_ID_CURR",
        "int": "MONTHS_BALANCE SK_DPD SK_DPD_DEF",
        "double": """
            AMT_DRAWINGS_ATM_CURRENT AMT_DRAWINGS_CURRENT AMT_DRAWINGS_OTHER_CURRENT
            AMT_INST_MIN_REGULARITY AMT_PAYMENT_TOTAL_CURRENT AMT_RECIVABLE AMT_TOTAL_RECEIVABLE
            CNT_DRAWINGS_ATM_CURRENT CNT_DRAWINGS_CURRENT CNT_DRAWINGS_OTHER_CURRENT
            CNT_DRAWINGS_POS_CURRENT CNT_INSTALMENT_MATURE_CUM
        """,
        "string": "NAME_CONTRACT_STATUS",
    },
}


def known_types(table: str) -> dict[str, str]:
    """Column types of one of the eight tables, as far as they are known."""
    return {c: kind for kind, names in TABLE_TYPES[table].items() for c in names.split()}
