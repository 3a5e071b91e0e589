"""Collector configuration: defaults that the outputs must reproduce.

Every value here is a fixed value of the billing rules or of the printed
documents.  Callers override them with a plain dict of the same shape.
"""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

# --- fixed values -----------------------------------------------------------
DEFAULT_ISSUE_DATE = _dt.date(2025, 3, 1)

# Distribution shares per tax type (recipient, share).  Fire is not split.
DISTRIBUTION_SHARES = {
    "Real Estate": (("township", Decimal("0.80")), ("county", Decimal("0.15")),
                    ("school", Decimal("0.05"))),
    "Per Capita": (("township", Decimal("0.50")), ("school", Decimal("0.50"))),
}

# Bank accounts used when the configuration names none.
BANK_ACCOUNTS = {
    "township": ("Township General Fund", "N/A"),
    "county": ("County Tax Account", "N/A"),
    "school": ("School District", "N/A"),
}

ORGANIZATION = {
    "township_name": "MUNICIPALITY NAME",
    "collector_name": "Tax Collector Name",
    "collector_title": "Tax Collector",
    "mailing_address": "123 Main St",
    "city_state_zip": "City, State Zip",
}

CONTACT = {
    "email": "collector@example.com",
    "subject_template": "Tax Inquiry - Parcel {parcel_id}",
    "body_template": (
        "Hello Tax Collector,\n\nI am writing regarding Parcel {parcel_id}.\n\n"
        "Please assist me with:\n[ ] Requesting a receipt\n[ ] Updating my mailing address\n"
        "[ ] Question about my bill\n\nMy phone number is: _________________\n\n"
        "Thank you,\n{owner_name}"
    ),
}

# Label sheet geometry (3 across, 10 down; inches).
LABELS_ACROSS = 3
LABELS_DOWN = 10
LABEL_WIDTH_IN = 2.625
LABEL_HEIGHT_IN = 1.0
# Origin of a label's text inside its cell, inches.
LABEL_TEXT_X_IN = 0.1
LABEL_TEXT_Y_IN = 0.6
LABEL_TEXT_DROP_IN = 0.8
LABEL_LEFT_MARGIN_IN = 0.1875
LABEL_TOP_OFFSET_IN = 0.5
LABEL_COL_GUTTER_IN = 0.125
PAGE_HEIGHT_IN = 11.0

# The status report's line where nothing was collected (fixed value).
NO_PAYMENTS_LINE = "| (No Payments Yet) | - | - |"

# Texts of the lookup panel (fixed values).
LOOKUP_PAID = "This bill has been PAID IN FULL. No further action is required."
LOOKUP_EXONERATED = "This bill has been EXONERATED. No balance is due."
LOOKUP_RETURNED = "This bill remains UNPAID and has been RETURNED to the County."

# Paid-in-full threshold on balance_remaining for an explicit PAYMENT row.
PAID_BALANCE_EPSILON = Decimal("0.009")
# Settlement is balanced when |charges - credits| is below this.
SETTLEMENT_TOLERANCE = Decimal("0.02")
# ----------------------------------------------------------------------------


def distribution_rows(shares: dict | None = None) -> list[tuple[str, str, Decimal]]:
    """(tax_type, recipient, share) rows in natural order."""
    shares = shares or DISTRIBUTION_SHARES
    return [(tax_type, recipient, Decimal(str(share)))
            for tax_type, pairs in shares.items() for recipient, share in pairs]
