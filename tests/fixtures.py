"""Inline fixtures (FIXTURES.md F1-F9)."""

F1_CONTRACT = (
    "اتفاقية خدمة\n"
    "اسم العميل: ماجد بن فهد الحربي\n"
    "رقم الهوية: 1076543219\n"
    "الجوال: +966 50 987 6543\n"
    "البريد الإلكتروني: majed.harbi@example.net\n"
    "العنوان: حي الياسمين، أبها\n"
    "\n"
    "Service Agreement\n"
    "Applicant: Laura Bennett\n"
    "Email: laura.bennett@example.net\n"
    "IBAN: SA4420000001234567891234\n"
    "Card: 5500 0000 0000 0004\n"
)

F2_LABELS = ("اسم العميل: ماجد بن فهد الحربي\n"
             "رقم الهوية: 1076543219\n"
             "البريد الإلكتروني: majed.harbi@example.net\n"
             "رقم الآيبان: SA4420000001234567891234\n"
             "العنوان: حي الياسمين، أبها  \n")

F3_GLUED = (":اسم العميلماجد بن فهد الحربي\n"
            ":رقم الهوية1076543219\n"
            ":رقم الآيبانSA4420000001234567891234\n"
            ":العنوانحي الياسمين، أبها\n")

F4_REVERSED = ("الحربي فهد بن ماجد :العميل اسم\n"
               "أبها الياسمين، حي :العنوان\n"
               "Tenant: Laura Bennett\n")
