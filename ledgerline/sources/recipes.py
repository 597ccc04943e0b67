"""What each synthetic filer reports, as a table of parameters.

One row: (tag, unit, shape, measure, numerator, denominator, condition).  The
reported figure is ``measure * numerator div denominator`` in whole cents, so
every engine gets the same integer.  Conditions are plain comparisons over
``cik``, ``industry``, ``yr`` (the year of the period's end), ``q`` (its
quarter) and ``{y0}``, the first year of the sales.
"""

USD, PER_SHARE, SHARES = "USD", "USD/shares", "shares"
_REV = "industry <> 'bank'"
_OPERATING = "industry NOT IN ('bank', 'pc', 'life')"
_CARRIERS = "industry IN ('pc', 'life', 'health')"
_PRETAX = "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest"
_LOANS = "FinancingReceivableExcludingAccruedInterestAfterAllowanceForCreditLoss"
_ALLOWANCE = "FinancingReceivableAllowanceForCreditLossExcludingAccruedInterest"
_EQUITY_ALL = "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"

SPANS = [
    ("Revenues", USD, "rev", 1, 1, f"cik % 3 = 0 AND {_REV}"),
    ("Revenues", USD, "rev", 1, 1, "cik % 4 = 1 AND industry = 'bank'"),
    ("RevenuesNetOfInterestExpense", USD, "rev", 9, 10, f"cik % 11 = 3 AND {_REV}"),
    ("RevenueFromContractWithCustomerExcludingAssessedTax", USD, "rev", 1, 1, f"cik % 3 = 1 AND {_REV}"),
    ("SalesRevenueNet", USD, "rev", 1, 1, f"cik % 3 = 2 AND {_REV}"),
    ("InterestAndDividendIncomeOperating", USD, "rev", 3, 4, "industry = 'bank'"),
    ("InterestIncomeExpenseNet", USD, "rev", 1, 2, "industry = 'bank' AND cik % 2 = 0"),
    ("NoninterestIncome", USD, "rev", 1, 4, "industry = 'bank'"),
    ("NoninterestExpense", USD, "fin", 1, 2, "industry = 'bank'"),
    ("ProvisionForLoanLeaseAndOtherLosses", USD, "rev", 1, 20, "industry = 'bank'"),
    ("CostOfGoodsAndServicesSold", USD, "fin", 1, 1, "cik % 4 = 1"),
    ("CostOfGoodsAndServicesSold", USD, "fin", 1, 1000, "cik % 4 = 0 AND yr >= {y0} + 2"),
    ("CostOfRevenue", USD, "fin", 1, 1, "cik % 4 IN (0, 2)"),
    ("GrossProfit", USD, "gp", 1, 1, "cik % 8 IN (0, 1)"),
    ("OperatingIncomeLoss", USD, "gp", 1, 2, f"{_OPERATING} AND cik % 10 <> 9"),
    ("DepreciationDepletionAndAmortization", USD, "rev", 1, 25, "cik % 6 <> 5"),
    ("ShareBasedCompensation", USD, "rev", 1, 50, "cik % 2 = 0 AND q = 4"),
    ("InterestExpense", USD, "rev", 1, 40, "cik % 7 <> 1"),
    ("InterestExpense", USD, "rev", 1, 8, "industry = 'bank'"),
    (_PRETAX, USD, "gp", 2, 5, "cik >= 0"),
    ("IncomeTaxExpenseBenefit", USD, "gp", 1, 10, "cik >= 0"),
    ("DeferredIncomeTaxExpenseBenefit", USD, "gp", 1, 100, "cik % 2 = 1"),
    ("NetIncomeLoss", USD, "gp", 3, 10, "cik % 13 <> 4"),
    ("ProfitLoss", USD, "gp", 31, 100, "cik >= 0"),
    ("NetIncomeLossAvailableToCommonStockholdersBasic", USD, "gp", 7, 20, "cik % 9 = 2"),
    ("NetIncomeLossAvailableToCommonStockholdersBasic", USD, "gp", 29, 100, "cik % 9 IN (5, 6)"),
    ("SellingGeneralAndAdministrativeExpense", USD, "rev", 1, 10, "cik >= 0"),
    ("ResearchAndDevelopmentExpense", USD, "rev", 1, 12, "industry = 'corporate'"),
    ("NetCashProvidedByUsedInOperatingActivities", USD, "gp", 9, 20, "cik >= 0"),
    ("PaymentsToAcquirePropertyPlantAndEquipment", USD, "rev", 3, 50, "cik % 5 <> 3"),
    ("PaymentsOfDividendsCommonStock", USD, "gp", 1, 20, "cik % 3 <> 1"),
    ("GoodwillImpairmentLoss", USD, "rev", 0, 1, "cik % 3 = 1"),
    ("AssetImpairmentCharges", USD, "rev", 1, 30, "cik % 6 IN (1, 2)"),
    ("OtherNonoperatingIncomeExpense", USD, "rev", 0, 1, "cik % 4 = 3"),
    ("NonoperatingIncomeExpense", USD, "rev", 1, 60, "cik % 8 = 3"),
    ("EarningsPerShareDiluted", PER_SHARE, "gp", 1, 1000000, "cik % 5 <> 4"),
    ("CommonStockDividendsPerShareDeclared", PER_SHARE, "qty", 1, 1000, "cik % 2 = 0"),
    ("WeightedAverageNumberOfDilutedSharesOutstanding", SHARES, "qty", 1, 1, "cik >= 0"),
    ("PremiumsEarnedNet", USD, "rev", 4, 5, _CARRIERS),
    ("PremiumsWrittenNet", USD, "rev", 17, 20, "industry = 'pc'"),
    ("PolicyholderBenefitsAndClaimsIncurredNet", USD, "fin", 3, 4, _CARRIERS),
    ("LiabilityForFuturePolicyBenefitsPeriodExpense", USD, "rev", 1, 20, "industry = 'pc' AND cik % 2 = 0"),
    ("DeferredPolicyAcquisitionCostAmortizationExpense", USD, "rev", 1, 10, "industry IN ('pc', 'life')"),
    ("OtherUnderwritingExpense", USD, "rev", 1, 16, "industry = 'pc' AND cik % 4 <> 3"),
    ("CededPremiumsEarned", USD, "rev", 1, 30, "industry = 'pc'"),
    ("NetInvestmentIncome", USD, "rev", 1, 12, _CARRIERS),
    ("InterestCreditedToPolicyholdersAccountBalances", USD, "rev", 1, 25, "industry = 'life'"),
    ("LaborAndRelatedExpense", USD, "rev", 2, 5, "industry = 'advisory'"),
    ("OperatingLeaseLeaseIncome", USD, "rev", 7, 8, "industry = 'reit'"),
    ("DirectCostsOfLeasedAndRentedPropertyOrEquipment", USD, "fin", 1, 3, "industry = 'reit'"),
    ("GainLossOnSaleOfProperties", USD, "rev", 1, 35, "industry = 'reit' AND cik % 2 = 0"),
    ("ImpairmentOfRealEstate", USD, "rev", 1, 80, "industry = 'reit' AND cik % 4 = 2"),
    ("AdvertisingExpense", USD, "rev", 1, 77, "cik % 2 = 0"),
    ("Supplies", USD, "rev", 1, 99, "cik % 3 = 0"),
    ("ReorganizationItems", USD, "rev", 1, 200, "cik % 20 = 9 AND yr <= {y0} + 3"),
    ("DebtorReorganizationItemsLegalAndAdvisoryProfessionalFees", USD, "rev", 1, 400, "cik % 40 = 9 AND yr <= {y0} + 3"),
]

BALANCES = [
    ("Assets", USD, "rev", 1, 1, "cik >= 0"),
    ("Liabilities", USD, "rev", 1, 2, "cik % 4 <> 3"),
    ("StockholdersEquity", USD, "gp", 1, 3, "cik % 5 NOT IN (1, 4)"),
    ("StockholdersEquity", USD, "rev", 1, 100, "cik % 5 = 1"),
    (_EQUITY_ALL, USD, "gp", 7, 20, "cik % 3 = 1 OR cik % 5 = 4"),
    ("MinorityInterest", USD, "rev", 1, 200, "cik % 6 = 4"),
    ("PreferredStockValue", USD, "rev", 1, 300, "cik % 7 = 3"),
    ("AssetsCurrent", USD, "rev", 2, 5, _OPERATING),
    ("LiabilitiesCurrent", USD, "rev", 1, 5, _OPERATING),
    ("CashAndCashEquivalentsAtCarryingValue", USD, "rev", 1, 10, "cik >= 0"),
    ("ShortTermInvestments", USD, "rev", 1, 33, "cik % 2 = 1"),
    ("AccountsReceivableNetCurrent", USD, "rev", 1, 9, _OPERATING),
    ("InventoryNet", USD, "fin", 1, 9, "industry = 'corporate'"),
    ("AccountsPayableCurrent", USD, "fin", 1, 11, _OPERATING),
    ("Goodwill", USD, "rev", 1, 14, "cik % 2 = 0"),
    ("IntangibleAssetsNetExcludingGoodwill", USD, "rev", 1, 28, "cik % 4 = 0"),
    ("LongTermDebtNoncurrent", USD, "rev", 1, 6, "cik % 6 IN (0, 1, 2)"),
    ("LongTermDebtNoncurrent", USD, "rev", 1, 6, "cik % 6 IN (3, 4) AND yr <= {y0} + 1"),
    ("LongTermDebt", USD, "rev", 1, 5, "cik % 6 = 3"),
    ("LongTermDebt", USD, "rev", 1, 6, "cik % 6 = 4"),
    ("LongTermDebtNoncurrent", USD, "rev", 0, 1, "cik % 12 = 11"),
    ("LongTermDebt", USD, "rev", 1, 8, "cik % 60 = 11"),
    ("LongTermDebtCurrent", USD, "rev", 1, 30, "cik % 6 <> 5 OR cik % 4 = 1"),
    ("ShortTermBorrowings", USD, "rev", 1, 30, "cik % 12 = 0"),
    ("ShortTermBorrowings", USD, "rev", 1, 45, "cik % 12 = 2"),
    ("ShortTermBorrowings", USD, "rev", 0, 1, "cik % 12 = 1"),
    ("ShortTermBorrowings", USD, "rev", -1, 10, "cik % 24 = 7"),
    ("CommercialPaper", USD, "rev", 1, 70, "cik % 12 = 1"),
    ("DebtLongtermAndShorttermCombinedAmount", USD, "rev", 1, 3, "cik % 10 = 2"),
    ("DebtLongtermAndShorttermCombinedAmount", USD, "rev", 1, 50, "cik % 10 = 6"),
    ("NotesPayable", USD, "rev", 1, 4, "industry = 'reit' AND cik % 2 = 0"),
    ("OperatingLeaseLiabilityNoncurrent", USD, "rev", 1, 44, "cik % 3 = 2"),
    (_LOANS, USD, "rev", 1, 2, "industry = 'bank'"),
    (_ALLOWANCE, USD, "rev", 1, 90, "industry = 'bank' AND cik % 28 <> 15"),
    (_ALLOWANCE, USD, "rev", -1, 90, "industry = 'bank' AND cik % 28 = 15"),
    ("Deposits", USD, "rev", 3, 5, "industry = 'bank'"),
    ("LiabilityForClaimsAndClaimsAdjustmentExpense", USD, "rev", 1, 3, "industry IN ('pc', 'health')"),
    ("ReinsuranceRecoverableForUnpaidClaimsAndClaimsAdjustments", USD, "rev", 1, 20, "industry = 'pc'"),
    ("UnearnedPremiums", USD, "rev", 1, 10, "industry = 'pc'"),
    ("DeferredPolicyAcquisitionCosts", USD, "rev", 1, 40, "industry IN ('pc', 'life')"),
    ("Investments", USD, "rev", 2, 3, "industry IN ('pc', 'life')"),
    ("LiabilityForFuturePolicyBenefits", USD, "rev", 1, 3, "industry = 'life'"),
    ("PolicyholderFunds", USD, "rev", 1, 4, "industry = 'life'"),
    ("AccumulatedOtherComprehensiveIncomeLossNetOfTax", USD, "rev", 1, 500, "industry = 'life'"),
    ("RealEstateGrossAtCarryingValue", USD, "rev", 9, 10, "industry = 'reit'"),
    ("RealEstateAccumulatedDepreciation", USD, "rev", 1, 5, "industry = 'reit'"),
    ("LiabilitiesSubjectToCompromise", USD, "rev", 1, 7, "cik % 20 = 9 AND yr <= {y0} + 3"),
    ("ReorganizationValue", USD, "rev", 1, 3, "cik % 60 = 9 AND yr = {y0} + 3"),
    ("EntityCommonStockSharesOutstanding", SHARES, "qty", 1, 1, "cik % 17 <> 16"),
]

# Tags that the special filings repeat: dual currency, proxy statement, amendments, second calendar.
REVENUE_LIKE = [
    "Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet",
    "InterestAndDividendIncomeOperating",
]
DUAL_CURRENCY = [*REVENUE_LIKE, "NetIncomeLoss", "ProfitLoss"]
SIC_BY_REMAINDER = ["7372", "6021", "6331", "6311", "6324", "6211", "6798"]
