"""Sections added for one industry only."""

from ledgerline.dims.model import computed, fetched, manual, market, section

# Line keys, labels and the order in which candidate tags are tried.
OVERLAY_SECTIONS = {
"bank": (
    section("bank_is", "Bank Income Statement", tab="statements", lines=(
        fetched("intIncTotal", "Total interest income", "InterestAndDividendIncomeOperating"),
        fetched("intExpTotal", "Total interest expense", "InterestExpense"),
        fetched("intExpDeposits", "Interest expense on deposits", "InterestExpenseDeposits"),
        fetched("nii", "Net interest income", "InterestIncomeExpenseNet"),
        fetched("provision", "Provision for credit losses",
                "ProvisionForLoanLeaseAndOtherLosses",
                "ProvisionForCreditLosses"),
        fetched("niiAfterProv", "NII after provision", "InterestIncomeExpenseAfterProvisionForLoanLoss"),
        fetched("noninterestIncome", "Noninterest income", "NoninterestIncome"),
        fetched("noninterestExpense", "Noninterest expense", "NoninterestExpense"),
        computed("totalRevenueBank", "Total revenue (NII + fees)"),
    )),
    section("bank_bs", "Loans, Deposits & Securities", tab="statements", instant=True, lines=(
        fetched("loans", "Loans & leases, net",
                "FinancingReceivableExcludingAccruedInterestAfterAllowanceForCreditLoss",
                "LoansAndLeasesReceivableNetReportedAmount",
                "LoansAndLeasesReceivableNetOfDeferredIncome",
                "NotesReceivableNet"),
        computed("loansGross", "Loans & leases, gross"),
        fetched("allowance", "Allowance for credit losses",
                "FinancingReceivableAllowanceForCreditLossExcludingAccruedInterest",
                "FinancingReceivableAllowanceForCreditLosses"),
        fetched("deposits", "Total deposits", "Deposits"),
        fetched("afs", "Securities available for sale",
                "DebtSecuritiesAvailableForSaleExcludingAccruedInterest",
                "AvailableForSaleSecuritiesDebtSecurities",
                "AvailableForSaleSecurities"),
        fetched("htm", "Securities held to maturity",
                "DebtSecuritiesHeldToMaturityExcludingAccruedInterestAfterAllowanceForCreditLoss",
                "HeldToMaturitySecurities"),
    )),
    section("bank_ratios", "Bank Ratios", tab="ratios", lines=(
        computed("efficiency", "Efficiency ratio"),
        computed("niiOnAssets", "Net interest income / assets"),
        computed("loansToDeposits", "Loans / deposits"),
        computed("allowanceToLoans", "Allowance / gross loans"),
        computed("provisionToLoans", "Provision / gross loans"),
        computed("depositsToAssets", "Deposits / assets"),
        computed("equityToAssets", "Equity / assets"),
    )),
),
"pc": (
    section("pc_uw", "Underwriting", tab="statements", after="is", kind="is", lines=(
        fetched("npw", "Net premiums written",
                "PremiumsWrittenNet",
                "SupplementaryInsuranceInformationPremiumsWritten",
                "SupplementalInformationForPropertyCasualtyInsuranceUnderwritersPremiumsWritten"),
        fetched("npe", "Net premiums earned",
                "PremiumsEarnedNet",
                "SupplementaryInsuranceInformationPremiumRevenue",
                "PremiumsEarnedNetPropertyAndCasualty"),
        fetched("cededPrem", "Ceded premiums earned",
                "CededPremiumsEarned",
                "CededPremiumsEarnedPropertyAndCasualty"),
        fetched("invIncome", "Net investment income",
                "NetInvestmentIncome",
                "SupplementaryInsuranceInformationNetInvestmentIncome",
                "InvestmentIncomeNet"),
        fetched("realizedGains", "Realised investment gains/(losses)",
                "RealizedInvestmentGainsLosses",
                "GainLossOnInvestments",
                "MarketableSecuritiesRealizedGainLoss"),
        fetched("lossesIncurred", "Losses & LAE incurred",
                "PolicyholderBenefitsAndClaimsIncurredNet",
                "SupplementaryInsuranceInformationBenefitsClaimsLossesAndSettlementExpense"),
        fetched("lifeBenefits", "Life & annuity policy benefits",
                "LiabilityForFuturePolicyBenefitsPeriodExpense"),
        fetched("cyLosses", "— current accident year",
                "SupplementalInformationForPropertyCasualtyInsuranceUnderwritersCurrentYearClaimsAndClaimsAdjustmentExpense",
                "SecSchedule1218SupplementalInformationPropertyCasualtyInsuranceUnderwritersCurrentYearClaimAndClaimAdjustmentExpense"),
        fetched("pyDevelopment", "— prior-year reserve development",
                "SupplementalInformationForPropertyCasualtyInsuranceUnderwritersPriorYearClaimsAndClaimsAdjustmentExpense",
                "SecSchedule1218SupplementalInformationPropertyCasualtyInsuranceUnderwritersPriorYearClaimAndClaimAdjustmentExpense"),
        fetched("dacAmort", "Policy acquisition costs amortised",
                "DeferredPolicyAcquisitionCostAmortizationExpense",
                "SupplementaryInsuranceInformationAmortizationOfDeferredPolicyAcquisitionCosts",
                "SupplementalInformationForPropertyCasualtyInsuranceUnderwritersAmortizationOfDeferredPolicyAcquisitionCosts"),
        fetched("otherUwExp", "Other underwriting expenses",
                "OtherUnderwritingExpense",
                "SellingGeneralAndAdministrativeExpense",
                "GeneralAndAdministrativeExpense",
                "SupplementaryInsuranceInformationOtherOperatingExpense"),
        fetched("totalBenExp", "Total benefits, losses & expenses", "BenefitsLossesAndExpenses"),
        computed("uwProfit", "Underwriting profit/(loss)"),
    )),
    section("pc_res", "Reserves, Float & Investments", tab="statements", after="bs", kind="bs", instant=True, lines=(
        fetched("lossReserves", "Loss & LAE reserves, gross",
                "LiabilityForClaimsAndClaimsAdjustmentExpense",
                "SupplementalInformationForPropertyCasualtyInsuranceUnderwritersReservesForUnpaidClaimsAndClaimsAdjustmentExpense"),
        fetched("reinsRecov", "Reinsurance recoverable on unpaid claims",
                "ReinsuranceRecoverableForUnpaidClaimsAndClaimsAdjustments",
                "ReinsuranceRecoverables"),
        fetched("lossReservesNet", "Loss & LAE reserves, net of reinsurance",
                "LiabilityForUnpaidClaimsAndClaimsAdjustmentExpenseNet"),
        fetched("unearnedPrem", "Unearned premiums",
                "UnearnedPremiums",
                "SupplementaryInsuranceInformationUnearnedPremiums",
                "SupplementalInformationForPropertyCasualtyInsuranceUnderwritersUnearnedPremiums"),
        fetched("dac", "Deferred policy acquisition costs",
                "DeferredPolicyAcquisitionCosts",
                "DeferredPolicyAcquisitionCostsNet",
                "SupplementaryInsuranceInformationDeferredPolicyAcquisitionCosts"),
        computed("float", "Insurance float"),
        fetched("investments", "Total investments", "Investments", "InvestmentsFairValueDisclosure"),
        fetched("fixedMaturities", "Fixed maturities, available for sale",
                "DebtSecuritiesAvailableForSaleExcludingAccruedInterest",
                "AvailableForSaleSecuritiesDebtSecurities",
                "AvailableForSaleSecurities"),
        fetched("equitySec", "Equity securities",
                "EquitySecuritiesFvNi",
                "EquitySecuritiesFvNiCurrentAndNoncurrent",
                "AvailableForSaleSecuritiesEquitySecurities"),
    )),
    section("pc_ratios", "Underwriting Ratios", tab="ratios", lines=(
        computed("lossRatio", "Loss & LAE ratio"),
        computed("expenseRatio", "Underwriting expense ratio"),
        computed("combinedRatio", "Combined ratio"),
        computed("pyDevRatio", "Prior-year development / NPE"),
        computed("premiumLeverage", "Net premiums written / equity"),
        computed("reserveLeverage", "Reserves / equity"),
        computed("cededRatio", "Ceded / gross earned premium"),
        computed("investmentYield", "Yield on investments"),
    )),
),
"life": (
    section("life_is", "Premiums, Fees & Benefits", tab="statements", after="is", kind="is", lines=(
        fetched("premiums", "Premiums earned, net",
                "PremiumsEarnedNet",
                "SupplementaryInsuranceInformationPremiumRevenue"),
        fetched("policyFees", "Policy fees & other insurance revenue",
                "InsuranceCommissionsAndFees",
                "PolicyChargesInsurance"),
        fetched("invIncome", "Net investment income",
                "NetInvestmentIncome",
                "SupplementaryInsuranceInformationNetInvestmentIncome"),
        fetched("realizedGains", "Realised investment gains/(losses)",
                "RealizedInvestmentGainsLosses",
                "GainLossOnInvestments"),
        fetched("benefits", "Policyholder benefits & claims",
                "PolicyholderBenefitsAndClaimsIncurredNet",
                "SupplementaryInsuranceInformationBenefitsClaimsLossesAndSettlementExpense"),
        fetched("interestCredited", "Interest credited to account balances",
                "InterestCreditedToPolicyholdersAccountBalances",
                "InterestCreditedToPolicyOwnerAccount",
                "InterestCreditedToPolicyOwnerAccounts"),
        fetched("dacAmort", "DAC amortisation",
                "DeferredPolicyAcquisitionCostAmortizationExpense",
                "SupplementaryInsuranceInformationAmortizationOfDeferredPolicyAcquisitionCosts"),
        fetched("totalBenExp", "Total benefits & expenses", "BenefitsLossesAndExpenses"),
    )),
    section("life_bs", "Policy Reserves & Investments", tab="statements", after="bs", kind="bs", instant=True, lines=(
        fetched("futurePolicyBenefits", "Future policy benefits", "LiabilityForFuturePolicyBenefits"),
        fetched("policyholderAccounts", "Policyholder account balances",
                "PolicyholderFunds",
                "PolicyholderContractDeposits"),
        fetched("separateAccounts", "Separate account assets", "SeparateAccountAssets"),
        fetched("dac", "Deferred policy acquisition costs",
                "DeferredPolicyAcquisitionCosts",
                "DeferredPolicyAcquisitionCostsNet",
                "SupplementaryInsuranceInformationDeferredPolicyAcquisitionCosts"),
        fetched("investments", "Total investments", "Investments", "InvestmentsFairValueDisclosure"),
        fetched("fixedMaturities", "Fixed maturities, available for sale",
                "DebtSecuritiesAvailableForSaleExcludingAccruedInterest",
                "AvailableForSaleSecuritiesDebtSecurities",
                "AvailableForSaleSecurities"),
        fetched("reinsRecov", "Reinsurance recoverable",
                "ReinsuranceRecoverables",
                "ReinsuranceRecoverableForUnpaidClaimsAndClaimsAdjustments"),
    )),
    section("life_ratios", "Life Insurance Ratios", tab="ratios", lines=(
        computed("benefitRatio", "Benefit ratio"),
        computed("creditingRate", "Crediting rate on account balances"),
        computed("investmentYield", "Yield on investments"),
        computed("policyReserves", "Total policy reserves"),
        computed("reserveLeverage", "Policy reserves / equity"),
        computed("bvpsExAoci", "Book value per share, ex-AOCI"),
    )),
),
"health": (
    section("health_is", "Premiums & Medical Costs", tab="statements", after="is", kind="is", lines=(
        fetched("premiums", "Premiums earned, net",
                "PremiumsEarnedNet",
                "HealthCareOrganizationPremiumRevenue"),
        fetched("medicalCosts", "Medical costs / benefits incurred",
                "PolicyholderBenefitsAndClaimsIncurredNet",
                "PolicyholderBenefitsAndClaimsIncurredHealthCare"),
        fetched("invIncome", "Net investment income", "NetInvestmentIncome", "InvestmentIncomeInterest"),
        fetched("medicalClaimsPayable", "Medical claims payable",
                "LiabilityForClaimsAndClaimsAdjustmentExpense",
                instant=True),
    )),
    section("health_ratios", "Health Plan Ratios", tab="ratios", lines=(
        computed("mlr", "Medical loss ratio"),
        computed("healthSgaRatio", "Operating cost ratio"),
        computed("daysClaimsPayable", "Days in claims payable"),
        computed("premiumMix", "Premiums / total revenue"),
    )),
),
"advisory": (
    section("adv_is", "Compensation", tab="statements", after="is", kind="is", lines=(
        fetched("compExpense", "Compensation & benefits",
                "LaborAndRelatedExpense",
                "EmployeeBenefitsAndShareBasedCompensation"),
    )),
    section("adv_ratios", "Broker-Dealer Ratios", tab="ratios", lines=(
        computed("compRatio", "Compensation ratio"),
        computed("pretaxMargin", "Pre-tax margin"),
        computed("tangibleEquity", "Tangible common equity"),
        computed("rote", "Return on tangible equity"),
    )),
),
"reit": (
    section("reit_ops", "Property Operations & FFO", tab="statements", after="is", kind="is", lines=(
        fetched("rentalRevenue", "Rental & lease income",
                "OperatingLeaseLeaseIncome",
                "LeaseIncome",
                "OperatingLeasesIncomeStatementLeaseRevenue",
                "RealEstateRevenueNet"),
        fetched("propOpex", "Property operating expenses",
                "DirectCostsOfLeasedAndRentedPropertyOrEquipment",
                "CostOfOtherPropertyOperatingExpense"),
        fetched("realEstateTax", "Real estate taxes", "RealEstateTaxExpense"),
        computed("noi", "Net operating income (NOI)"),
        fetched("reDep", "— of which real estate (Schedule III)",
                "SECScheduleIIIRealEstateAccumulatedDepreciationDepreciationExpense"),
        fetched("gainOnPropertySale", "Gain/(loss) on property sales",
                "GainLossOnSaleOfProperties",
                "GainsLossesOnSalesOfInvestmentRealEstate",
                "GainLossOnDispositionOfAssets",
                "GainLossOnSaleOfPropertyPlantEquipment"),
        fetched("reImpairment", "Real estate impairment", "ImpairmentOfRealEstate", "AssetImpairmentCharges"),
        fetched("straightLineRent", "Straight-line rent adjustment", "StraightLineRent"),
        computed("ffo", "FFO (NAREIT basis)"),
        computed("ffoPerShare", "FFO per share, diluted"),
        manual("affo", "AFFO / Core FFO"),
    )),
    section("reit_bs", "Real Estate & Leverage", tab="statements", after="bs", kind="bs", instant=True, lines=(
        fetched("reGross", "Real estate, at cost",
                "RealEstateGrossAtCarryingValue",
                "RealEstateInvestmentPropertyAtCost"),
        fetched("reAccumDep", "Accumulated depreciation, real estate",
                "RealEstateAccumulatedDepreciation",
                "RealEstateInvestmentPropertyAccumulatedDepreciation"),
        computed("reNet", "Real estate, net"),
        fetched("reitDebt", "Debt outstanding, as disclosed",
                "NotesPayable",
                "LongTermDebt",
                "DebtLongtermAndShorttermCombinedAmount"),
        fetched("numProperties", "Properties owned", "NumberOfRealEstateProperties"),
    )),
    section("reit_ratios", "REIT Ratios", tab="ratios", lines=(
        computed("ffoPayout", "Dividend payout (of FFO)"),
        computed("noiMargin", "NOI margin"),
        computed("debtToGrossRE", "Debt / real estate at cost"),
        computed("accumDepPct", "Accumulated depreciation / cost"),
    )),
),
}
