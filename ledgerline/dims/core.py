"""Sections that every filer carries."""

from ledgerline.dims.model import computed, fetched, manual, market, section

# Line keys, labels and the order in which candidate tags are tried.
CORE_SECTIONS = (
    section("is", "Income Statement", tab="statements", kind="is", lines=(
        fetched("revenue", "Total revenue",
                "Revenues",
                "RevenuesNetOfInterestExpense",
                "RevenueFromContractWithCustomerExcludingAssessedTax",
                "RevenueFromContractWithCustomerIncludingAssessedTax",
                "SalesRevenueNet",
                "GrossInvestmentIncomeOperating",
                "InterestAndDividendIncomeOperating",
                omit={"bank": ("InterestAndDividendIncomeOperating",)}),
        fetched("cogs", "Cost of revenue",
                "CostOfGoodsAndServicesSold",
                "CostOfRevenue",
                "CostOfServices",
                pinned=True),
        fetched("grossProfit", "Gross profit", "GrossProfit"),
        fetched("rnd", "Research & development", "ResearchAndDevelopmentExpense"),
        fetched("sam", "Selling & marketing", "SellingAndMarketingExpense", "MarketingExpense"),
        fetched("ga", "General & administrative", "GeneralAndAdministrativeExpense"),
        fetched("sga", "SG&A (combined)", "SellingGeneralAndAdministrativeExpense"),
        fetched("otherOpex", "Other operating expense",
                "OtherCostAndExpenseOperating",
                "RestructuringCharges"),
        fetched("totalOpex", "Total operating expenses", "OperatingExpenses", "CostsAndExpenses"),
        fetched("totalCosts", "Total costs & expenses", "CostsAndExpenses"),
        fetched("ebit", "Operating income (EBIT)", "OperatingIncomeLoss"),
        fetched("da", "Depreciation & amortisation",
                "DepreciationDepletionAndAmortization",
                "DepreciationAmortizationAndAccretionNet",
                "DepreciationAndAmortization",
                "Depreciation"),
        computed("ebitda", "EBITDA"),
        fetched("sbc", "Stock-based compensation",
                "ShareBasedCompensation",
                "AllocatedShareBasedCompensationExpense"),
        computed("ebitdaSbc", "EBITDA ex-SBC"),
        fetched("intExp", "Interest expense",
                "InterestExpense",
                "InterestExpenseDebt",
                "InterestExpenseNonoperating"),
        fetched("intInc", "Interest income", "InvestmentIncomeInterest", "InterestIncomeOther"),
        fetched("otherInc", "Other income/(expense), net",
                "OtherNonoperatingIncomeExpense",
                "NonoperatingIncomeExpense",
                prefer_nonzero=True),
        fetched("pretax", "Pre-tax income",
                "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
                "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments"),
        fetched("tax", "Income tax expense", "IncomeTaxExpenseBenefit"),
        fetched("netIncome", "Net income", "NetIncomeLoss", "ProfitLoss"),
        fetched("nci", "Less: noncontrolling interest", "NetIncomeLossAttributableToNoncontrollingInterest"),
        fetched("niToCommon", "Net income to common", "NetIncomeLossAvailableToCommonStockholdersBasic"),
        fetched("prefDiv", "Preferred dividends", "PreferredStockDividendsIncomeStatementImpact"),
    )),
    section("bs", "Balance Sheet", tab="statements", kind="bs", instant=True, lines=(
        fetched("cash", "Cash & equivalents",
                "CashAndCashEquivalentsAtCarryingValue",
                "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"),
        fetched("sti", "Short-term investments",
                "ShortTermInvestments",
                "MarketableSecuritiesCurrent",
                "AvailableForSaleSecuritiesDebtSecuritiesCurrent"),
        fetched("ar", "Accounts receivable, net", "AccountsReceivableNetCurrent", "ReceivablesNetCurrent"),
        fetched("inventory", "Inventory", "InventoryNet"),
        fetched("prepaid", "Prepaid & other current assets",
                "OtherAssetsCurrent",
                "PrepaidExpenseAndOtherAssetsCurrent"),
        fetched("curAssets", "Total current assets", "AssetsCurrent"),
        fetched("ppe", "PP&E, net", "PropertyPlantAndEquipmentNet"),
        fetched("ppeGross", "PP&E, gross", "PropertyPlantAndEquipmentGross"),
        fetched("accumDep", "Accumulated depreciation",
                "AccumulatedDepreciationDepletionAndAmortizationPropertyPlantAndEquipment"),
        fetched("goodwill", "Goodwill", "Goodwill"),
        fetched("intangibles", "Intangibles, ex-goodwill",
                "FiniteLivedIntangibleAssetsNet",
                "IntangibleAssetsNetExcludingGoodwill"),
        fetched("olRou", "Operating lease right-of-use asset", "OperatingLeaseRightOfUseAsset"),
        fetched("ltInvest", "Long-term investments", "LongTermInvestments", "MarketableSecuritiesNoncurrent"),
        fetched("otherAssets", "Other non-current assets", "OtherAssetsNoncurrent"),
        fetched("totalAssets", "Total assets", "Assets"),
        fetched("ap", "Accounts payable",
                "AccountsPayableCurrent",
                "AccountsPayableAndAccruedLiabilitiesCurrent"),
        fetched("accrued", "Accrued liabilities",
                "AccruedLiabilitiesCurrent",
                "EmployeeRelatedLiabilitiesCurrent"),
        fetched("defRevCur", "Deferred revenue, current",
                "ContractWithCustomerLiabilityCurrent",
                "DeferredRevenueCurrent"),
        fetched("stDebt", "Short-term borrowings",
                "ShortTermBorrowings",
                "CommercialPaper",
                "OtherShortTermBorrowings",
                prefer_nonzero=True),
        fetched("ltdCur", "Current portion of long-term debt", "LongTermDebtCurrent"),
        fetched("olCur", "Operating lease liability, current", "OperatingLeaseLiabilityCurrent"),
        fetched("flCur", "Finance lease liability, current", "FinanceLeaseLiabilityCurrent"),
        fetched("curLiab", "Total current liabilities", "LiabilitiesCurrent"),
        fetched("debtAllIn", "Debt outstanding, long + short", "DebtLongtermAndShorttermCombinedAmount"),
        fetched("ltDebt", "Long-term debt",
                "LongTermDebtNoncurrent",
                "LongTermDebt",
                "LongTermDebtAndCapitalLeaseObligationsIncludingCurrentMaturities",
                "DebtAndCapitalLeaseObligations",
                "LongTermDebtAndCapitalLeaseObligations",
                "ConvertibleDebtNoncurrent"),
        fetched("olNon", "Operating lease liability, non-current", "OperatingLeaseLiabilityNoncurrent"),
        fetched("flNon", "Finance lease liability, non-current", "FinanceLeaseLiabilityNoncurrent"),
        fetched("defTaxLiab", "Deferred tax liabilities",
                "DeferredIncomeTaxLiabilitiesNet",
                "DeferredTaxLiabilitiesNoncurrent"),
        fetched("pension", "Pension & post-retirement",
                "DefinedBenefitPensionPlanLiabilitiesNoncurrent",
                "LiabilityDefinedBenefitPlanNoncurrent"),
        fetched("totalLiab", "Total liabilities", "Liabilities"),
        fetched("tempEquity", "Mezzanine (redeemable) equity",
                "TemporaryEquityCarryingAmountAttributableToParent",
                "TemporaryEquityCarryingAmountIncludingPortionAttributableToNoncontrollingInterest",
                "TemporaryEquityCarryingAmount"),
        fetched("preferred", "Preferred stock", "PreferredStockValue"),
        fetched("retained", "Retained earnings", "RetainedEarningsAccumulatedDeficit"),
        fetched("treasury", "Treasury stock", "TreasuryStockValue", "TreasuryStockCommonValue"),
        fetched("aoci", "AOCI", "AccumulatedOtherComprehensiveIncomeLossNetOfTax"),
        fetched("equity", "Total shareholders' equity",
                "StockholdersEquity",
                "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"),
        fetched("equityAll", "Total equity incl. NCI",
                "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"),
        fetched("nciBs", "Noncontrolling interest", "MinorityInterest"),
    )),
    section("cf", "Cash Flow", tab="statements", kind="cf", lines=(
        fetched("cfDa", "D&A (cash flow)",
                "DepreciationDepletionAndAmortization",
                "DepreciationAmortizationAndAccretionNet"),
        fetched("deferredTax", "Deferred income taxes", "DeferredIncomeTaxExpenseBenefit"),
        fetched("chgAr", "Change in receivables", "IncreaseDecreaseInAccountsReceivable"),
        fetched("chgInv", "Change in inventory", "IncreaseDecreaseInInventories"),
        fetched("chgAp", "Change in payables", "IncreaseDecreaseInAccountsPayable"),
        fetched("cfo", "Cash from operations",
                "NetCashProvidedByUsedInOperatingActivities",
                "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"),
        fetched("capex", "Capital expenditures",
                "PaymentsToAcquirePropertyPlantAndEquipment",
                "PaymentsToAcquireProductiveAssets"),
        fetched("capSoftware", "Capitalised software", "PaymentsToDevelopSoftware", "PaymentsForSoftware"),
        fetched("acquisitions", "Acquisitions, net of cash", "PaymentsToAcquireBusinessesNetOfCashAcquired"),
        fetched("divestitures", "Divestitures", "ProceedsFromDivestitureOfBusinesses"),
        fetched("cfi", "Cash from investing", "NetCashProvidedByUsedInInvestingActivities"),
        fetched("debtIssued", "Debt issued",
                "ProceedsFromIssuanceOfLongTermDebt",
                "ProceedsFromIssuanceOfDebt",
                "ProceedsFromNotesPayable",
                prefer_nonzero=True),
        fetched("debtRepaid", "Debt repaid", "RepaymentsOfLongTermDebt", "RepaymentsOfDebt"),
        fetched("buybacks", "Share repurchases", "PaymentsForRepurchaseOfCommonStock"),
        fetched("dividends", "Dividends paid",
                "PaymentsOfDividendsCommonStock",
                "PaymentsOfDividends",
                "PaymentsOfOrdinaryDividends",
                "DividendsCommonStockCash"),
        fetched("cff", "Cash from financing", "NetCashProvidedByUsedInFinancingActivities"),
        computed("fcf", "Free cash flow"),
        computed("fcfConv", "FCF conversion"),
    )),
    section("sh", "Share Data", tab="statements", lines=(
        fetched("epsBasic", "EPS, basic", "EarningsPerShareBasic"),
        fetched("epsDil", "EPS, diluted", "EarningsPerShareDiluted"),
        fetched("wasoBasic", "Weighted avg shares, basic", "WeightedAverageNumberOfSharesOutstandingBasic"),
        fetched("wasoDil", "Weighted avg shares, diluted", "WeightedAverageNumberOfDilutedSharesOutstanding"),
        fetched("sharesOut", "Shares outstanding (cover)",
                "dei:EntityCommonStockSharesOutstanding",
                latest=True,
                instant=True),
        fetched("dps", "Dividends per share", "CommonStockDividendsPerShareDeclared"),
    )),
    section("margins", "Margins & Growth", tab="ratios", lines=(
        computed("grossMargin", "Gross margin"),
        computed("ebitdaMargin", "EBITDA margin"),
        computed("ebitMargin", "EBIT margin"),
        computed("netMargin", "Net margin"),
        computed("fcfMargin", "FCF margin"),
        computed("revGrowth", "Revenue growth, YoY"),
        computed("ebitdaGrowth", "EBITDA growth, YoY"),
        computed("epsGrowth", "EPS growth, YoY"),
        computed("revCagr3", "Revenue CAGR, 3yr"),
        computed("revCagr5", "Revenue CAGR, 5yr"),
        computed("taxRate", "Effective tax rate"),
    )),
    section("credit", "Credit & Leverage", tab="ratios", lines=(
        computed("totalDebt", "Total debt"),
        computed("totalDebtLeases", "Total debt incl. leases"),
        computed("netDebt", "Net debt"),
        computed("netLev", "Net debt / EBITDA"),
        computed("grossLev", "Total debt / EBITDA"),
        computed("intCover", "EBITDA / interest expense"),
        computed("fccr", "(EBITDA − capex) / interest"),
        computed("debtEquity", "Debt / equity"),
        computed("debtCap", "Debt / total capital"),
        computed("currentRatio", "Current ratio"),
        computed("quickRatio", "Quick ratio"),
    )),
    section("debtlike", "Debt-Like Items", tab="valuation", kind="bs", instant=True, lines=(
        fetched("pensionUnderfunded", "Underfunded pension",
                "DefinedBenefitPlanFundedStatusOfPlan",
                "DefinedBenefitPensionPlanLiabilitiesNoncurrent"),
        fetched("deferredComp", "Deferred compensation", "DeferredCompensationLiabilityClassifiedNoncurrent"),
        fetched("assetRetirement", "Asset retirement obligations", "AssetRetirementObligationsNoncurrent"),
        fetched("uncertainTax", "Uncertain tax positions", "LiabilityForUncertainTaxPositionsNoncurrent"),
        computed("debtLikeTotal", "Total debt-like items"),
    )),
    section("addbacks", "Add-Back Candidates", tab="valuation", kind="is", lines=(
        fetched("restructuring", "Restructuring charges",
                "RestructuringCharges",
                "RestructuringSettlementAndImpairmentProvisions"),
        fetched("impairment", "Goodwill / asset impairment",
                "GoodwillImpairmentLoss",
                "AssetImpairmentCharges",
                prefer_nonzero=True),
        fetched("acquisitionCosts", "Acquisition-related costs",
                "BusinessCombinationAcquisitionRelatedCosts"),
        fetched("litigation", "Litigation settlements",
                "LitigationSettlementExpense",
                "LossContingencyAccrualAtCarryingValue"),
        fetched("gainOnSale", "Gains/(losses) on disposal",
                "GainLossOnDispositionOfAssets",
                "GainLossOnSaleOfBusiness"),
        manual("adjEbitda", "Adjusted EBITDA"),
    )),
    section("returns", "Returns & Working Capital", tab="ratios", lines=(
        computed("nopat", "NOPAT"),
        computed("investedCap", "Invested capital"),
        computed("roic", "ROIC"),
        computed("roe", "ROE"),
        computed("roa", "ROA"),
        computed("assetTurn", "Asset turnover"),
        computed("dso", "DSO"),
        computed("dio", "DIO"),
        computed("dpo", "DPO"),
        computed("ccc", "Cash conversion cycle"),
        computed("nwc", "Net working capital"),
        computed("nwcPctRev", "NWC % of revenue"),
        computed("capexPctRev", "Capex % of revenue"),
        computed("daPctRev", "D&A % of revenue"),
        computed("sbcPctRev", "SBC % of revenue"),
    )),
    section("ev", "EV Bridge & Valuation", lines=(
        market("price", "Share price"),
        market("mktCap", "Market capitalisation"),
        market("ev", "Enterprise value"),
        market("evRev", "EV / Revenue"),
        market("evEbitda", "EV / EBITDA"),
        market("evEbit", "EV / EBIT"),
        market("evFcf", "EV / FCF"),
        market("pe", "P / E"),
        market("pb", "P / B"),
        market("fcfYield", "FCF yield"),
        market("divYield", "Dividend yield"),
        computed("bvps", "Book value per share"),
        computed("tbvps", "Tangible book per share"),
    )),
    section("dcf", "DCF Inputs", tab="valuation", kind="tax", lines=(
        computed("ufcf", "Unlevered FCF"),
        computed("chgNwc", "Change in NWC"),
        computed("cashTaxRate", "Cash tax rate"),
        computed("netDebtBridge", "Net debt (equity bridge)"),
        fetched("nol", "NOL carryforwards",
                "OperatingLossCarryforwards",
                "DeferredTaxAssetsOperatingLossCarryforwards",
                instant=True),
        fetched("taxCredits", "Tax credit carryforwards",
                "TaxCreditCarryforwardAmount",
                "DeferredTaxAssetsTaxCreditCarryforwards",
                instant=True),
        manual("wacc", "WACC"),
        manual("terminalGrowth", "Terminal growth"),
    )),
    section("dilution", "Dilution & Equity Awards", tab="valuation", kind="sbc", instant=True, lines=(
        fetched("optionsOut", "Options outstanding",
                "ShareBasedCompensationArrangementByShareBasedPaymentAwardOptionsOutstandingNumber"),
        fetched("optionsStrike", "Weighted avg exercise price",
                "ShareBasedCompensationArrangementByShareBasedPaymentAwardOptionsOutstandingWeightedAverageExercisePrice"),
        fetched("rsuOut", "Unvested RSUs",
                "ShareBasedCompensationArrangementByShareBasedPaymentAwardEquityInstrumentsOtherThanOptionsNonvestedNumber"),
        fetched("unrecognisedComp", "Unrecognised comp cost",
                "EmployeeServiceShareBasedCompensationNonvestedAwardsTotalCompensationCostNotYetRecognized"),
        computed("treasuryMethod", "Fully diluted shares (TSM)"),
    )),
    section("premia", "Premia Paid", lines=(
        market("undisturbed", "Undisturbed share price"),
        manual("offerPrice", "Offer price per share"),
        computed("premium1d", "Premium to undisturbed"),
    )),
    section("lbo", "LBO Inputs", lines=(
        computed("ltmEbitda", "LTM EBITDA"),
        computed("ltmRevenue", "LTM revenue"),
        computed("entryNetDebt", "Net debt at entry"),
        manual("maintCapex", "Maintenance capex"),
        manual("addBacks", "EBITDA add-backs"),
        manual("sourcesUses", "Sources & uses"),
        manual("debtTranches", "Debt tranches & pricing"),
    )),
    section("pta", "Precedent Transactions", lines=(
        fetched("ptaFilings", "Related 8-K / DEFM14A"),
        manual("ptaMultiples", "Transaction multiples"),
    )),
)
