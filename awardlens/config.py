"""Fixed values and the settings of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field

# Published column names, and the names used here.
COLUMNS = {
    "As of Date": "as_of_date",
    "Fiscal Year": "fiscal_year_published",
    "Region": "region",
    "Borrower Country / Economy": "borrower_country",
    "Borrower Country / Economy Code": "borrower_country_code",
    "Project ID": "project_id",
    "Project Name": "project_name",
    "Project Global Practice": "global_practice_raw",
    "Procurement Category": "procurement_category",
    "Procurement Method": "procurement_method_raw",
    "WB Contract Number": "contract_id",
    "Contract Description": "contract_description",
    "Borrower Contract Reference Number": "borrower_reference",
    "Contract Signing Date": "signing_date_raw",
    "Supplier ID": "supplier_id",
    "Supplier": "supplier_name_raw",
    "Supplier Country / Economy": "supplier_country",
    "Supplier Country / Economy Code": "supplier_country_code",
    "Supplier Contract Amount (USD)": "amount_usd",
    "Review type": "review_type",
    "Contract signed - Calendar year": "signed_calendar_year",
}
REQUIRED = ("supplier_name_raw", "borrower_country", "procurement_category", "amount_usd", "signing_date_raw", "procurement_method_raw")

COMPETITIVE, NON_COMPETITIVE = "COMPETITIVE", "NON_COMPETITIVE"
# Procurement methods and their class; the note is ours.
METHODS = {
    "Request for Bids": (COMPETITIVE, "Bids are asked for in public."),
    "Request for Quotations": (COMPETITIVE, "Several quotations are compared."),
    "Request for Proposals": (COMPETITIVE, "Proposals are scored on merit and price."),
    "Quality And Cost-Based Selection": (COMPETITIVE, "A shortlist is scored on quality and cost."),
    "Quality Based Selection": (COMPETITIVE, "A shortlist is scored on quality alone."),
    "Least Cost Selection": (COMPETITIVE, "The cheapest of those good enough wins."),
    "Fixed Budget Selection": (COMPETITIVE, "The best offer within a known budget wins."),
    "Consultant Qualification  Selection": (COMPETITIVE, "Qualifications of a shortlist are compared; no price is."),
    "Individual Consultant Selection": (COMPETITIVE, "Several persons' qualifications are compared."),
    "E-Auctions": (COMPETITIVE, "Prices are bid against each other."),
    "Direct Selection": (NON_COMPETITIVE, "One source, without any other offer."),
    "Force Account": (NON_COMPETITIVE, "The borrower's own units do the work."),
    "UN Agencies (Direct)": (NON_COMPETITIVE, "Awarded to an agency directly."),
    "Commercial Practices": (NON_COMPETITIVE, "By the buyer's own practice; the record shows no other offer."),
    "Non-Profit Organizations": (NON_COMPETITIVE, "Engaged directly."),
    "Procurement Agents": (NON_COMPETITIVE, "The record is the agent's appointment."),
    "Community Driven Development": (NON_COMPETITIVE, "Left to the community; the record shows no other offer."),
    "Public Private Partnership": (NON_COMPETITIVE, "The record doesn't show how the partner was found."),
}

# Names that stand for no particular supplier.
PLACEHOLDERS = ("INDIVIDUAL CONSULTANT", "INDIVIDUAL CONSULTANTS", "N/A", "NA", "NONE", "UNKNOWN", "TBD", "-", ".", "")
# Legal forms at the end of a supplier's name, tried in this order.
LEGAL_SUFFIXES = (
    "PRIVATE LIMITED", "PVT LTD", "CO LTD", "COMPANY LIMITED", "LIMITED", "INCORPORATED", "CORPORATION", "LLC", "LLP", "PLC", "LTDA", "LTD",
    "INC", "CORP", "GMBH", "S A R L", "SARL", "S A S", "SAS", "S P A", "SPA", "S A", "SA", "BV", "NV", "AB", "AS", "OY", "PTY", "PT", "CIA", "CIE",
)
# Parts of the names of borrowers that are no single country.
REGIONAL_MARKERS = (
    "AFRICA", "ASIA", "PACIFIC", "CARIBBEAN", "BALKANS", "REGIONAL", "MULTI-REGIONAL", "MULTIREGIONAL", "WORLD", "OCEAN", "EASTERN AND",
    "WESTERN AND", "LATIN AMERICA", "MIDDLE EAST", " - ",
)
# Jurisdictions with little ownership transparency.
SECRECY = (
    "Bahamas", "Barbados", "Belize", "Bermuda", "British Virgin Islands", "Virgin Islands, British", "Cayman Islands", "Cyprus", "Gibraltar",
    "Guernsey", "Isle of Man", "Jersey", "Liechtenstein", "Luxembourg", "Malta", "Marshall Islands", "Mauritius", "Monaco", "Panama", "Seychelles",
)


@dataclass(frozen=True)
class EngineConfig:
    """Every threshold. Passed explicitly; rules read it when they are built into a plan."""

    version: str = "v1.0"
    data_as_of: str = "2026-08-22"
    #: Days from signing to assessment: history and benchmarks are read as of the signing date plus this lag.
    assessment_lag_days: int = 0
    min_group_support: int = 30
    sketch_points: int = 101
    min_median: float = 1.0
    train_years: tuple[int, ...] = (2020, 2021, 2022)
    validation_years: tuple[int, ...] = (2023,)
    test_years: tuple[int, ...] = (2024, 2025, 2026)
    truncated_years: tuple[int, ...] = (2027,)
    amount_multiple: float = 150.0
    non_competitive_amount: float = 2_000_000.0
    first_contract_ratio: float = 20.0
    secrecy: tuple[str, ...] = SECRECY
    target_quantile: float = 0.75
    contamination: float = 0.01
    missing_value: float = -999.0
    within_range_ratio: float = 5.0
    #: The benchmark over all contracts as the last resort.
    overall_rung: bool = True
    #: "month": a benchmark exists in months in which its group has a contract; "asof": the latest one up to the month.
    lookup: str = "month"
    #: History counts contracts, credited to the first supplier by name ("contract"), or every supplier's row ("row").
    history_grain: str = "contract"
    #: Without a detector no record is ROUTINE.
    require_detector: bool = False
    methods: dict[str, tuple[str, str]] = field(default_factory=lambda: dict(METHODS))

    def splits(self) -> dict[str, tuple[int, ...]]:
        return {"train": self.train_years, "validate": self.validation_years, "test": self.test_years, "truncated": self.truncated_years}


DEFAULT = EngineConfig()
