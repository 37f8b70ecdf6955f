"""Two members with known outcomes, rendered as the documents they would hand in."""

from datetime import date, timedelta

STATEMENT_HEAD = "Form 26AS\nAnnual Tax Statement\n\n"
TABLE_HEAD = "Sr. No.  Name of Deductor   TAN of Deductor  Total Amount Paid  Total Tax Deducted  Deposited"
ROW_HEAD = "Sr. No.  Section  Transaction Date  Status  Date of Booking  Remarks  Paid  Tax  Deposited"



def month_ends(year, month, n):
    """The last days of ``n`` months in a row, as statements write them."""
    firsts = [date(year + (month + k) // 12, (month + k) % 12 + 1, 1) for k in range(n)]
    return [(first - timedelta(days=1)).strftime("%d-%b-%Y") for first in firsts]


TIDEWATER_DAYS = month_ends(2013, 10, 7)
MERIDIAN_DAYS = month_ends(2018, 2, 8)
QUILLHAVEN_DAYS = month_ends(2018, 11, 5)
OAKFERN_DAYS = month_ends(2020, 7, 9)


def block(n, name, tan, days, paid, tax, amounts=None):
    amounts = amounts or [paid] * len(days)
    lines = [TABLE_HEAD, f"{n}  {name}  {tan}  {paid * len(days):.2f}  {tax * len(days):.2f}  {tax * len(days):.2f}",
             ROW_HEAD]
    for i, (day, amount) in enumerate(zip(days, amounts), 1):
        lines.append(f"{i}  192  {day}  F  15-Jun-2022  {amount:.2f}  {tax:.2f}  {tax:.2f}")
    return "\n".join(lines)


def statement(name, pan, *blocks):
    return (STATEMENT_HEAD + f"Permanent Account Number (PAN)    {pan}\nName of Assessee   {name}\n\n"
            + "PART A - Details of Tax Deducted at Source\n\n" + "\n\n".join(blocks) + "\n")


def passbook(est_code, est_name, account, name, born, joined, uan, rows):
    body = "\n".join(f"{m}      {e}      {r}      {p}" for m, e, r, p in rows)
    return (f"EPF Member Passbook\n\nEstablishment ID / Name   {est_code} / {est_name}\n"
            f"Member ID                 {account}\nMember Name               {name}\n"
            f"Date of Birth             {born}\nDate of Joining (EPF)     {joined}\nUAN    {uan}\n\n"
            f"Wage Month    Employee Share    Employer Share    Pension Contribution\n{body}\n")


def history(*rows):
    return ("Service History\n\nMember ID   Establishment   Date of Joining   Date of Exit\n"
            + "\n".join("   ".join(r) for r in rows) + "\n")


def bank(holder, *rows):
    return (f"Statement of Account\nAccount Holder   {holder}\n\nDate  Narration  Amount  Type\n"
            + "\n".join("  ".join(r) for r in rows) + "\n")


def months_of(days):
    return [d[3:] for d in days]


MERIDIAN, QUILLHAVEN, OAKFERN = "GJSRT00417290000003307", "WBCAL00836140000001196", "KDMAL00552030000000418"
SALARY = "NEFT CR-ICIC0000104-MERIDIAN LOOMWORKS-SALARY"


def defective(member="GM1"):
    """A lost first account, an exit dated three months early, and one never dated."""
    return [
        (member, "a-statement", statement(
            "ISHAAN DEV TALWAR", "KLMPT4821Q",
            block(1, "TIDEWATER CANNERY PRIVATE LIMITED", "VPNT22417F", TIDEWATER_DAYS, 31000, 900),
            block(2, "MERIDIAN LOOMWORKS PRIVATE LIMITED", "SRTM60318H", MERIDIAN_DAYS, 52000, 2100),
            block(3, "QUILLHAVEN OPTICS PRIVATE LIMITED", "KOLQ81925D", QUILLHAVEN_DAYS, 59000, 2750))),
        (member, "b-meridian", passbook(
            MERIDIAN[:15], "MERIDIAN LOOMWORKS PVT LTD", MERIDIAN, "ISHAAN D TALWAR", "09-07-1987",
            "05-02-2018", "100482615937", [(m, 6240, 1910, 1180) for m in months_of(MERIDIAN_DAYS)])),
        (member, "c-quillhaven", passbook(
            QUILLHAVEN[:15], "QUILLHAVEN OPTICS PVT LTD", QUILLHAVEN, "ISHAAN TALWAR", "09-07-1987",
            "12-11-2018", "100482615937", [(m, 7080, 2430, 1250) for m in months_of(QUILLHAVEN_DAYS)])),
        (member, "d-history", history(
            (MERIDIAN, "MERIDIAN LOOMWORKS PVT LTD", "05-02-2018", "30-06-2018"),
            (QUILLHAVEN, "QUILLHAVEN OPTICS PVT LTD", "12-11-2018", "-"))),
        (member, "e-bank", bank(
            "ISHAAN TALWAR",
            ("28-03-2018", SALARY + " MAR18", "49,900.00", "CR"),
            ("27-04-2018", SALARY + " APR18", "49,900.00", "CR"),
            ("10-05-2018", "INT.CR HALF YEAR", "236.00", "CR"),
            ("30-07-2018", SALARY + " JUL18", "49,900.00", "CR"),
            ("29-08-2018", SALARY + " AUG18", "49,900.00", "CR"),
            ("02-09-2018", "POS 2217 GROCER", "1,840.00", "DR"),
            ("28-09-2018", SALARY + " SEP18", "49,900.00", "CR"))),
    ]


def clean(member="GM2"):
    """One account whose documents agree."""
    return [
        (member, "a-statement", statement(
            "LEELA VARGHESE", "QRSPV9034H",
            block(1, "OAKFERN ROBOTICS PRIVATE LIMITED", "CHNO37741B", OAKFERN_DAYS, 72500, 4150))),
        (member, "b-passbook", passbook(
            OAKFERN[:15], "OAKFERN ROBOTICS PVT LTD", OAKFERN, "LEELA VARGHESE", "21-11-1992",
            "01-07-2020", "100815340276", [(m, 8640, 3060, 1250) for m in months_of(OAKFERN_DAYS)])),
        (member, "d-history", history((OAKFERN, "OAKFERN ROBOTICS PVT LTD", "01-07-2020", "31-03-2021"))),
        (member, "e-bank", bank("LEELA VARGHESE", ("04-08-2020", "NEFT-OAKFERN ROBOTICS-SALARY JUL", "68350.00"))),
    ]


REGISTER = [
    ("TIDEWATER CANNERY PRIVATE LIMITED", "APVSP0071188000", True, date(2010, 8, 1), 1),
    ("MERIDIAN LOOMWORKS PRIVATE LIMITED", MERIDIAN[:15], True, date(2014, 3, 1), 2),
    ("QUILLHAVEN OPTICS PRIVATE LIMITED", QUILLHAVEN[:15], True, date(2016, 10, 1), 3),
    ("PEREIRA & DAUGHTERS BAKERY", "", False, None, 4),
]
AS_OF = date(2024, 5, 14)
