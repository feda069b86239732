"""Fixed values of the rule engine: what it looks for, as patterns over normalized text. Rules that use them are in engine.py."""

# Fixed values: (category, in titles, in duties) in the order of matching.
CATEGORIES = [
    ("Data Entry & Operations", r"data entry|data verification|operator (?:introducere|validare) date|ввод[а]? данных|оператор баз[ы]? данных", r"data entry|verify.{0,25}records|introducerea datelor|ввод данных"),
    ("QA & Testing", r"qa|tester|testare|test engineer|quality assurance|test automation|тестировщик[а-я]*|тестирование", r"test cases|bug reports?|manual testing|testare software|тестирование (?:по|программ)|тест-кейс[а-я]*"),
    ("Design & UX", r"ux|ui|web designer|graphic designer|designer grafic|design grafic|графический дизайнер|веб-дизайнер", r"user interface design|user research|wireframes|prototyping|design de interfete"),
    ("Product & Project Assistance", r"(?:it |technical |digital |junior |intern )?(?:product manager|product owner)|(?:it |digital )project (?:assistant|coordinator|manager)|(?:asistent|coordonator) proiecte (?:it|digitale)|business analyst|бизнес-аналитик|менеджер (?:it-?продукт[а-я]*|продукт[а-я]*)", r"product requirements|user stories|cerinte de business|roadmap|требования к продукту"),
    ("Cybersecurity & Monitoring", r"cybersecurity|security analyst|soc analyst|soc operator|information security|securitate cibernetica|аналитик.{0,15}безопасности", r"security incident|siem|threat detection|incident de securitate"),
    ("IT Support & Helpdesk", r"(?:it|technical|software|application|application management|systems?|billing systems|support license management) support|support (?:it|engineer|license management)|consultant functional erp|analist productie informatica|help ?desk|service desk|suport (?:it|tehnic)|asistenta tehnica|ит[- ]?поддержк[а-я]*|техническ[а-я]* поддержк[а-я]*|специалист ит", r"application support|user access management|technical issues|software issues|password reset|ticketing|help ?desk|troubleshoot[a-z]*|suport(?:ul)? (?:functional|tehnic|angajatilor|utilizatorilor)|probleme (?:tehnice|software)|техническ[а-я]* поддержк[а-я]*"),
    ("Systems & Networks", r"devops|sysadmin|linux|network administrator|system(?:s)? administrator|administrator (?:de )?(?:sistem[a-z]*|retele)|системн[а-я]* администратор|администратор сет[а-я]*", r"active directory|windows server|dhcp|dns|administrare[a-z]*.{0,25}retele|системное администрирование|linux.{0,20}network"),
    ("Data & Analytics", r"data (?:analyst|scientist|engineer)|analyst date|analytics|bi analyst|business intelligence|analist date|аналитик данных", r"data analysis|data visualization|power bi|tableau|analiza datelor|анализ данных"),
    ("Web Content & E-commerce", r"wordpress|web content|e-?commerce|content (?:editor|manager|assistant)|catalog(?:ue)?|suport web|administrat[a-z]*.{0,15}(?:site|web)|контент-менеджер", r"wordpress|product listings|product catalog|cms|administrarea site|catalog de produse"),
    ("Marketing & Web Tech", r"seo|smm|link ?builder|digital (?:marketing|specialist)|marketing digital|departament marketing|social media|copywriter|цифровой маркетинг", r"seo|smm|google ads|social media|marketing digital|link building"),
    ("Software Development", r"developer|programator|software engineer|software development|frontend|backend|full[- ]?stack|embedded|разработчик[а-я]*|программист[а-я]*", r"software development|write.{0,15}code|codebase|dezvoltarea.{0,25}software|programare|программирование|разработка программного обеспечения"),
    ("IT Internships", r"(?:it |software )internships?|internships? it|stagiu it|стажировк[а-я]*.{0,10}it", r"internship it|it internship|stagiu it|стажировк[а-я]*.{0,10}it"),
    ("General IT", r"it junior|junior it|entry-level it|it trainee|specialist it|specialist tic", r"information technology|tehnologii informationale|domeniul tic"),
]
DEVELOPER, NOT_DEVELOPER = r"developer|programator|программист[а-я]*|разработчик[а-я]*", r"data (?:entry|scientist|engineer)|wordpress|qa|test|1c"
NON_TECH = r"accountant|contabil[a-z]*|financial manager|finance|purchasing|achizitii|recruiter|recrutare|office manager|asistent director|ceo assistant|travel assistant|paralegal|lector|profesor|sales|vanzari|account manager|bucatar|casier|водитель|бухгалтер[а-я]*"
PLANNED, PLANNING, CODING = r"programat[a-z]*.{0,25}productie", r"planificarea|comenzilor de productie", r"scriere.{0,20}cod|dezvoltare.{0,20}software"
SKILLS = {
    "JavaScript / Node": r"javascript|typescript|node\.?js|react|vue|angular", "Python": "python", "Java": "java", "C# / .NET": r"c#|\.net|dotnet|asp\.net", "C++": r"c\+\+", "PHP": "php|laravel", "SQL / DB": r"sql|mysql|postgres(?:ql)?|sql server|mongodb",
    "Linux": "linux|unix", "Git": "git|github|gitlab", "Excel / Sheets": "excel|google sheets", "WordPress / CMS": "wordpress|cms", "Figma": "figma", "Manual Testing": "manual testing|testare manuala|ручное тестирование", "Test Automation": "selenium|cypress|playwright|test automation|automation testing|автоматизация тестирования",
}
LANGUAGES = {"English": r"english|englez[\p{L}]*|английск[а-я]*", "Romanian": "roman[ae]|romana|romanian|румынск[а-я]*", "Russian": "rusa|ruse|russian|русск[а-я]*", "Italian": "italian|italiana|итальянск[а-я]*", "German": "german|germana|немецк[а-я]*", "French": "french|franceza|французск[а-я]*"}
# Applicants.
OPTIONAL = r"preferred|nice to have|would be (?:a )?plus|(?:a|an) (?:plus|asset)|considered an? asset|optional|great to have|not mandatory|welcomed|(?:an? )?advantage|avantaj|de preferat|constituie un plus|желательно|(?:будет|является) (?:плюсом|преимуществом)|приветствуется"
NO_EXPERIENCE = r"no (?:prior |previous |professional |work )?experience(?: (?:is )?required| needed| necessary)?|no need (?:of|for) (?:working )?experience|without (?:prior |previous )?experience|experience.{0,45}(?:not required|not necessary|does not matter)|fara experienta|nu (?:este |e )?(?:necesara|nevoie de) experienta|experienta nu este (?:necesara|obligatorie)|experienta.{0,25}nu conteaza|без опыта|опыт.{0,45}не[ -]+(?:требуется|обязател[а-я]*|обязательно|име(?:ет|ют) значения)"
ENTRY_TITLE = r"junior|intern(?:ship)?|trainee|entry[- ]level|beginner|stagiar[a-z]*|stagiere|incepator[a-z]*|стажер[а-я]*|стажировк[а-я]*|начинающ[а-я]*|джуниор"
ENTRY_BODY = r"daca esti la inceput de (?:drum|cariera)|te putem invata restul|(?:acceptam|cautam).{0,25}incepatori|if you are.{0,30}(?:starting your career|a beginner)|beginner applicants (?:welcome|accepted)"
STUDENTS = r"students? (?:welcome|accepted|can apply|in|of)|accept[a-z]*.{0,15}student|(?:sau|or) students?|pentru studenti|studii.{0,50}in curs|студент[а-я]*|выпускник[а-я]*|absolvent[a-z]*|graduates?"
INTERNSHIP = r"intern(?:ship)?|trainee|stagiar[a-z]*|stagiu|стажировк[а-я]*|стажер[а-я]*"
SENIOR = r"senior|middle|mid[- ]level|lead|principal|head of|team lead|ведущ[а-я]*|старший"
ADVANCED = r"deep knowledge|extensive (?:knowledge|experience)|proven track record|expert[- ]level|cunostinte avansate|глубок[а-я]* знания|экспертн[а-я]* уров"
PRIOR, TOOL_USE, EMPLOYED = r"(?:previous|professional|work) experience|experienced in|experienta (?:de lucru|profesionala)|опыт работы", r"опыт работы с\s|experienta (?:de lucru )?cu\s", r"предыдущ|профессиональн|коммерческ|profesionala"
NO_DEGREE = r"no (?:degree|formal education|technical studies)|(?:degree|technical studies).{0,30}(?:not required|not necessary)|studii.{0,20}nu sunt obligatorii|без высшего образования"
DEGREE, DEGREE_OR = r"bachelor'?s?|university|higher education|completed degree|studii superioare|высшее (?:техническое )?образование", r"or equivalent|or relevant experience|sau experienta|in curs|student|pursuing|currently studying|незаконченн[а-я]*|студент[а-я]*|или опыт"
LANGUAGE_COURSE, LANGUAGE_KNOWN = r"courses?|cursuri|обучение|курсы", r"required|knowledge|cuno[a-z]*|владение|знание"
LANGUAGE_FREE, LANGUAGE_LEVEL = r"not required|not necessary|nu este obligator|не требуется", r"required|speak|knowledge|proficiency|fluent|intermediate|advanced|good|skills|perfect.{0,20}scris|b[12]|c[12]|limb[a-z]*|cuno[a-z]*|nivel|владение|знание|уровень|язык"
REACT_TO, REACT = r"react\s+to", r"javascript|typescript|node\.?js|vue|angular|React"
# Training and pay.
FEE = r"curs(?:uri)? contra cost|taxa de (?:instruire|participare|inscriere)|training fee|tuition fee|(?:pay|purchase|buy).{0,35}(?:training|course)|(?:training|course).{0,35}(?:costs?|fee)|платн[а-я]* (?:обучение|курс[а-я]*)|оплат[а-я]*.{0,25}(?:обучение|курс[а-я]*)|взнос.{0,25}обучение"
NO_FEE = r"no (?:training |tuition )?fees?|free (?:training|course)|no need to pay|do not (?:have to )?pay|without.{0,20}fee|fara tax[a-z]*|gratuit|бесплатн[а-я]*|не нужно платить|за счет (?:компании|работодателя)|company (?:pays|covers)|employer (?:pays|covers)"
COURSE_TITLE, TEACHER = r"(?:curs(?:uri)?|bootcamp|training course|курс[а-я]*)", r"instructor|trainer"
UNPAID = r"unpaid (?:internship|training|position)|(?:internship|training) is unpaid|stagiu neremunerat|fara (?:salariu|remunerare)|неоплачиваем[а-я]* (?:стажировк[а-я]*|обучение)|стажировк[а-я]*.{0,20}без оплаты"
TRAINING = r"(?:training|instruire|intruire) (?:provided|offered|oferim)|(?:we (?:will )?(?:offer|provide)|oferim|asiguram).{0,80}(?:training|instruire)|paid training|обучаем|предоставляем обучение|за счет.{0,20}обучение|обучение.{0,30}за счет|instruire (?:personala|completa|si mentorat)"
PAID_INTERNSHIP = r"paid (?:internship|training)|(?:internship|training).{0,25}(?:paid|salary)|salariu.{0,35}(?:instruire|stagiu)|программа.{0,30}оплачивается|оплачиваем[а-я]* стажировк[а-я]*"
LATER_JOB = r"angajare ulterioara|последующим трудоустройством|after (?:the )?(?:internship|training).{0,50}(?:salary|job)|salariu.{0,20}in acest caz"
PAID = r"salary|salariu|remunerat|зарплата|заработн[а-я]* плат[а-я]*|compensation|\d.{0,20}(?:mdl|usd|eur|lei)"
# Place and time.
RELOCATION = r"(?:relocat[a-z]*|onboarding|internship|training|stagiu|обучение|стажировк[а-я]*|переезд).{0,60}(?:germany|germania|германи[а-я]*|abroad|strainatate)|(?:mandatory|required).{0,20}relocation|location:\s*[^\n]{0,50}(?:germany|германи[а-я]*)"
ABROAD_TITLE, ABROAD = r"internship|стажировк[а-я]*", (r"travel costs reimbursement", r"free accommodation throughout the internship", r"after the internship.{0,70}chisinau")
ABROAD_SAID = r"germany|germania|германи|abroad|strainatate|travel costs reimbursement"
LOCAL, ANYWHERE = r"chisinau|кишин[её]в", r"moldova|worldwide|anywhere|молдова"
REMOTE_MODE, REMOTE_TEXT = r"remote|telecommut|la distanta|дистанцион|удален", r"(?:work|working|lucru|munca).{0,15}(?:remote|la distanta)|remote (?:work|position|role)|work from (?:your )?home|удаленн[а-я]* работ[а-я]*"
HYBRID = r"hybrid|hibrid|гибрид"
PART_TIME = r"part[- ]time|jumatate de norma|неполный"
FLEXIBLE = r"flexible (?:schedule|hours)|program flexibil|гибкий график"
SHIFTS = r"rotational|24\/7|24x7|shift work|night shifts?|rotating shifts?|lucru in ture|ночн[а-я]* смен[а-я]*|сменный график"
DRIVER = r"permis(?:ul)? de conducere|permis.{0,20}cat\.?\s*b|driver'?s licen[cs]e|driving licen[cs]e|водитель(?:ск|сик)[а-я]* (?:прав[а-я]*|удостоверение)"
PORTFOLIO = r"portfolio|portofoliu|портфолио"
CUSTOMERS = r"(?:phone|email|chat|tickets?|tichete|telefon|apeluri|клиент[а-я]*|пользовател[а-я]*).{0,50}(?:support|suport|поддержк[а-я]*)|(?:support|suport|поддержк[а-я]*).{0,50}(?:clients?|customers?|users?|clienti|клиент[а-я]*|пользовател[а-я]*)"
# Points of the score, and its limit by fit.
WEIGHTS = {"base": 35, "no_experience": 35, "entry_title": 20, "entry_body": 20, "student": 15, "training": 5}
CAPS = {"excluded": 0, "review": 49, "other": 30, "stretch": 65}
# Reasons, as they are shown.
EXCLUDED = {
    "unrelated": "The vacancy does not describe an IT or digital role.",
    "production": "The vacancy describes production scheduling rather than software development.",
    "fee": "A course or applicant training fee is advertised.",
    "unpaid": "The listing explicitly advertises unpaid work or training.",
    "relocation": "The programme requires onboarding or relocation abroad.",
    "outside": "The advertised workplace is outside Chișinău.",
    "experience": "At least two years of experience are required.",
    "senior": "The title advertises an experienced or senior role.",
    "closed": "The original vacancy page is no longer available.",
}
REASONS = {
    "no_experience": "The vacancy explicitly says experience is not required.",
    "entry_title": "The title advertises a junior, trainee or internship role.",
    "entry_body": "The vacancy explicitly offers a starting route for beginners.",
    "student": "Students or graduates are mentioned as applicants.",
    "student_prior": "Students are mentioned alongside prior experience; experience criteria take priority.",
    "training": "Employer training is mentioned; confirm any conditions before accepting.",
    "years": "At least %s year(s) of experience stated.",
    "alternative": "Experience is listed with a student alternative; confirm eligibility.",
    "incomplete": "Full vacancy details could not be verified.",
    "no_signal": "The vacancy does not explicitly welcome beginners.",
    "degree": "A completed degree appears in the requirements; students should check eligibility.",
    "advanced": "Advanced skills are requested despite the beginner signals.",
    "later_pay": "Only future employment pay is described; internship pay is not confirmed.",
    "unclear": "Previous work experience is requested without a clear minimum.",
    "no_place": "The workplace location is not confirmed.",
}
