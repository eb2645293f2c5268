"""Rule rows and fixed values.

Everything here is data: phrases, labels, hosts, thresholds.  The lists below
are fixed values that have to equal the published rule files for results to
agree, so they are written out plainly and in their natural order.  Operators
take them as parameters; pass other rows to bind an operator to another corpus.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: numeric settings -----------------------------------------
HASH_BUCKETS = 32
MAX_SHARD_ROWS = 2000
MAX_SHARD_BYTES = 2_097_152
MAX_FEED_ITEMS = 500
MAX_QUARANTINE = 200
MAX_SOURCES_PER_RUN = 2000
MISSES_SUSPECTED = 2
MISSES_CLOSED = 4
CLOSE_STATUS_CODES = (404, 410)
MIN_PUBLIC_CONFIDENCE = 0.55
PROMOTION_MIN_CONFIDENCE = 0.55
QUARANTINE_BELOW_CONFIDENCE = 0.35
ADAPTER_FAILURE_THRESHOLD = 0.5
ADAPTER_CRITICAL_RATE = 0.8
ADAPTER_MIN_SAMPLES = 10
CRAWL_URLS_PER_RUN = 150
SUMMARY_MAX_CHARS = 2000
POLL_TIER_MINUTES = {"hot": 2, "warm": 5, "cold": 8, "dormant": 20}
DEFAULT_TIER_MINUTES = 60
PARSER_VERSION = "1.0.0"
CLASSIFICATION_VERSION = "1.0.0"

# --- fixed values: disciplines (id, label, aliases) --------------------------
DISCIPLINES = [
    ("software", "Software Engineering", ["software engineering", "software", "swe", "sde", "developer"]),
    ("frontend", "Frontend", ["front-end", "front end", "ui engineer"]),
    ("backend", "Backend", ["back-end", "back end", "server"]),
    ("full_stack", "Full Stack", ["fullstack", "full-stack"]),
    ("mobile", "Mobile", ["ios", "android", "mobile engineer"]),
    ("systems", "Systems", ["systems engineer", "systems programming"]),
    ("infrastructure", "Infrastructure", ["infra engineer"]),
    ("cloud", "Cloud", ["cloud engineer", "cloud architect"]),
    ("devops", "DevOps", ["dev ops", "platform engineer"]),
    ("sre", "SRE", ["site reliability", "reliability engineer"]),
    ("cybersecurity", "Cybersecurity", ["security engineer", "infosec", "cyber security"]),
    ("networking", "Networking", ["network engineer"]),
    ("it", "IT", ["information technology", "it support"]),
    ("technical_support", "Technical Support", ["tech support", "support engineer"]),
    ("data_engineering", "Data Engineering", ["data engineer"]),
    ("data_science", "Data Science", ["data scientist", "ai/ml/data", "data science ai machine learning"]),
    ("machine_learning", "Machine Learning", ["ml engineer", "ml", "ai/ml"]),
    ("artificial_intelligence", "Artificial Intelligence", ["ai engineer", "ai researcher"]),
    ("quantitative_development", "Quantitative Development",
     ["quant", "quant dev", "quant developer", "quantitative developer", "quantitative trading"]),
    ("quantitative_research", "Quantitative Research",
     ["quant research", "quant researcher", "quantitative researcher"]),
    ("product", "Product", ["product manager", "product management", "pm"]),
    ("hardware", "Hardware", ["hardware engineer", "hardware engineering"]),
    ("embedded", "Embedded Systems", ["embedded engineer", "embedded software"]),
    ("firmware", "Firmware", ["firmware engineer"]),
    ("robotics", "Robotics", ["robotics engineer"]),
    ("qa_automation", "QA / Automation", ["qa engineer", "test automation", "quality assurance"]),
    ("other", "Other", []),
]

# --- fixed values: career levels (id, phrases), in rule order ----------------
CAREER_LEVELS = [
    ("internship", ["intern", "internship", "summer analyst", "winter analyst", "fall analyst",
                    "spring analyst", "summer associate", "winter associate", "step intern",
                    "university intern", "lead intern", "student intern"]),
    ("co_op", ["co-op", "coop", "co op"]),
    ("new_grad", ["new grad", "new graduate", "recent graduate", "recent grad", "university grad",
                  "university graduate", "campus hire", "campus recruiting", "campus recruit",
                  "graduating", "graduate engineer", "graduate developer", "graduate software",
                  "university hire", "college hire", "college graduate", "college grad",
                  "new college grad", "ncg", "class of", "university software", "grad software",
                  "software engineer graduate", "graduate software engineer"]),
    ("entry_level", ["entry level", "entry-level", "junior engineer", "junior developer",
                     "junior software", "junior analyst", "junior associate", "jr", "jr engineer",
                     "jr. engineer", "jr developer", "jr. developer", "jr software",
                     "early career", "early careers", "associate engineer",
                     "associate developer", "associate software", "software engineer associate",
                     "engineer i", "developer i", "analyst i", "sde i", "swe i",
                     "software engineer i", "associate product manager", "apm",
                     "campus software", "trainee"]),
    ("apprenticeship", ["apprentice", "apprenticeship"]),
    ("graduate_program", ["graduate program", "graduate scheme", "analyst program",
                          "leadership program"]),
    ("rotational_program", ["rotational program", "rotational engineer", "rotational analyst",
                            "rotational software"]),
    ("research_internship", ["research intern", "research internship"]),
    ("fellowship", ["fellowship", "research fellow"]),
    ("student_program", ["student program", "student engineer", "student developer",
                         "student software", "undergraduate", "undergrad", "student role",
                         "phd intern", "phd internship", "masters intern",
                         "university program", "campus program"]),
]
SENIOR_PHRASES = ["senior", "staff", "principal", "lead engineer", "engineering manager",
                  "director", "vp", "vice president", "head of", "mid-level", "mid level",
                  "experienced"]
# fixed patterns over the canonical title
SENIOR_TITLE = (r"\b(senior|sr\.?|staff|principal|manager|director|vp|vice\s+president|head\s+of|"
                r"chief|architect|iii|iv|mid[- ]level|experienced)\b")
LEAD_TITLE = r"\blead\b"
EARLY_TITLE = r"\b(intern|internship|co-?op|new\s+grad|student|apprentice|trainee|campus)\b"
# source metadata: (pattern, level, confidence), first match wins
SOURCE_LEVEL_HINTS = [
    (r"(?i)\b(intern|internship|co-?op|trainee)\b", "internship", 0.78),
    (r"(?i)\b(new\s+grads?|new\s+graduates?|university\s+grads?|campus\s+hire|grad\s+program)\b",
     "new_grad", 0.8),
    (r"(?i)\b(entry[- ]level|junior|early[- ]career|student|apprentice)\b", "entry_level", 0.72),
]

# --- fixed values: academic terms --------------------------------------------
_SEASON_TAIL = r"(?:\s+20\d{2}|\s+intern|\s+internship|\s+co-?op)?\b"
PRECISE_TERMS = [
    ("summer", r"(?i)\bsummer" + _SEASON_TAIL),
    ("fall", r"(?i)\b(?:fall|autumn)" + _SEASON_TAIL),
    ("winter", r"(?i)\bwinter" + _SEASON_TAIL),
    ("spring", r"(?i)\bspring(?!\s+boot)" + _SEASON_TAIL),
    ("rolling", r"(?i)\b(?:rolling\s+(?:admissions?|basis|applications?|hire|hiring)"
                r"|applications?\s+rolling)\b"),
    ("off_cycle", r"(?i)\boff[-\s]?cycle\b"),
]
# bare title words; rolling and spring are left out, they collide with other wording
TITLE_TERMS = [("winter", ["winter"]), ("summer", ["summer"]), ("fall", ["fall", "autumn"]),
               ("off_cycle", ["off-cycle", "off cycle"])]

# --- fixed values: skills (name, aliases) -------------------------------------
SKILLS = [
    ("Python", ["python3", "py"]), ("Java", []), ("C", []), ("C++", ["cpp", "c plus plus"]),
    ("C#", ["csharp", "c sharp"]), ("Go", ["golang"]), ("Rust", []),
    ("JavaScript", ["js", "ecmascript"]), ("TypeScript", ["ts"]),
    ("React", ["reactjs", "react.js"]), ("Next.js", ["nextjs"]), ("Node.js", ["nodejs", "node"]),
    ("SQL", []), ("PostgreSQL", ["postgres", "psql"]), ("MongoDB", ["mongo"]), ("Redis", []),
    ("Linux", []), ("Windows", []), ("AWS", ["amazon web services"]),
    ("Azure", ["microsoft azure"]), ("GCP", ["google cloud", "google cloud platform"]),
    ("Docker", ["containers"]), ("Kubernetes", ["k8s"]), ("Terraform", ["tf"]), ("Ansible", []),
    ("Git", []), ("GitHub Actions", ["gh actions"]), ("Jenkins", []),
    ("CI/CD", ["cicd", "continuous integration"]), ("TCP/IP", ["tcp ip"]), ("DNS", []),
    ("DHCP", []), ("BGP", []), ("OSPF", []), ("Wireshark", []), ("Splunk", []), ("SIEM", []),
    ("SOC", ["security operations center"]), ("IAM", ["identity access management"]),
    ("OAuth", []), ("SAML", []), ("Kotlin", []), ("Swift", []), ("PyTorch", ["pytorch"]),
    ("TensorFlow", ["tensorflow"]), ("Pandas", []), ("Spark", ["apache spark"]),
    ("Kafka", ["apache kafka"]),
]

# --- fixed values: benefit phrases (claim, positive, negative) ----------------
BENEFIT_CONFIDENCE = 0.85
BENEFITS = [
    ("visa_sponsorship",
     ["visa sponsorship", "will sponsor visa", "h-1b sponsorship", "h1b sponsorship",
      "work visa sponsorship", "sponsor work authorization"],
     ["no visa sponsorship", "unable to sponsor", "cannot sponsor", "will not sponsor",
      "not eligible for sponsorship", "must have unrestricted work authorization",
      "must be authorized to work"]),
    ("immigration_assistance",
     ["immigration assistance", "immigration support", "relocation and immigration"],
     ["no immigration assistance"]),
    ("international_candidates",
     ["international candidates welcome", "open to international applicants", "global candidates"],
     ["us citizens only", "must be legally authorized", "no international candidates"]),
    ("relocation_assistance",
     ["relocation assistance", "relocation package", "relocation support", "assisted relocation"],
     ["no relocation assistance", "relocation not provided", "relocation unavailable"]),
    ("relocation_stipend", ["relocation stipend", "relocation bonus"], ["no relocation stipend"]),
    ("moving_expenses", ["moving expenses", "moving allowance", "cover moving costs"],
     ["no moving expenses", "moving expenses not covered"]),
    ("airfare", ["airfare provided", "flight reimbursement", "airfare reimbursement"],
     ["no airfare", "airfare not provided"]),
    ("travel_reimbursement", ["travel reimbursement", "travel expenses reimbursed"],
     ["no travel reimbursement"]),
    ("housing_provided", ["housing provided", "company housing", "accommodation provided"],
     ["housing not provided", "no housing provided"]),
    ("housing_stipend", ["housing stipend", "housing allowance"], ["no housing stipend"]),
    ("temporary_housing", ["temporary housing", "short-term housing", "corporate apartment"],
     ["no temporary housing"]),
    ("fully_funded_relocation", ["fully funded relocation", "full relocation package"],
     ["no fully funded relocation"]),
]
# search flag -> claim
BENEFIT_FLAGS = {"visa": "visa_sponsorship", "relocation": "relocation_assistance",
                 "housing": "housing_provided", "airfare": "airfare"}

# --- fixed values: platforms (id, hosts, api url, board url, support) ----------
@dataclass(frozen=True)
class Platform:
    name: str
    hosts: tuple[str, ...]
    api: str | None = None
    board: str | None = None
    supported: bool = True


PLATFORMS = [
    Platform("greenhouse", ("boards.greenhouse.io", "job-boards.greenhouse.io", "boards-api.greenhouse.io"),
             "https://boards-api.greenhouse.io/v1/boards/{tenant}/jobs",
             "https://boards.greenhouse.io/{tenant}"),
    Platform("lever", ("jobs.lever.co", "api.lever.co"),
             "https://api.lever.co/v0/postings/{tenant}", "https://jobs.lever.co/{tenant}"),
    Platform("ashby", ("jobs.ashbyhq.com", "api.ashbyhq.com"),
             "https://api.ashbyhq.com/posting-api/job-board/{tenant}",
             "https://jobs.ashbyhq.com/{tenant}"),
    Platform("smartrecruiters", ("careers.smartrecruiters.com", "api.smartrecruiters.com"),
             "https://api.smartrecruiters.com/v1/companies/{tenant}/postings",
             "https://careers.smartrecruiters.com/{tenant}"),
    Platform("workday", ("myworkdayjobs.com", "wd1.myworkdayjobs.com", "wd3.myworkdayjobs.com",
                         "wd5.myworkdayjobs.com", "wd12.myworkdayjobs.com")),
    Platform("workable", ("apply.workable.com", "jobs.workable.com"),
             "https://apply.workable.com/api/v1/widget/accounts/{tenant}",
             "https://apply.workable.com/{tenant}"),
    Platform("icims", ("careers.icims.com",), supported=False),
    Platform("teamtailor", ("career.teamtailor.com", "jobs.teamtailor.com"), supported=False),
    Platform("recruitee", ("recruitee.com",), supported=False),
    Platform("bamboohr", ("bamboohr.com",), supported=False),
    Platform("successfactors", ("successfactors.com", "successfactors.eu"), supported=False),
    Platform("oracle", ("oraclecloud.com",), supported=False),
    Platform("json_ld", ()),
    Platform("simplify", ("raw.githubusercontent.com",),
             "https://raw.githubusercontent.com/SimplifyJobs/{tenant}/dev/.github/scripts/listings.json",
             "https://github.com/SimplifyJobs/{tenant}"),
]
FAST_PLATFORMS = ("greenhouse", "lever", "ashby")
DISCOVERY_PATTERNS = ["boards.greenhouse.io", "job-boards.greenhouse.io", "jobs.lever.co",
                      "jobs.ashbyhq.com", "careers.smartrecruiters.com"]
# (platform, pattern with the tenant as group 1) for mining board links from text
TENANT_PATTERNS = [
    ("greenhouse", r"boards(?:-api)?\.greenhouse\.io/(?:v1/boards/)?([a-z0-9][a-z0-9_-]{1,64})"),
    ("greenhouse", r"job-boards\.greenhouse\.io/([a-z0-9][a-z0-9_-]{1,64})"),
    ("lever", r"(?:jobs|api)\.lever\.co/(?:v0/postings/)?([a-z0-9][a-z0-9_-]{1,64})"),
    ("ashby", r"(?:jobs|api)\.ashbyhq\.com/(?:posting-api/job-board/)?([a-z0-9][a-z0-9_-]{1,64})"),
]
TENANT_STOPWORDS = ["v1", "v0", "boards", "postings", "job-board", "api", "www"]
PLATFORM_DOMAIN_TOKENS = ["greenhouse.io", "lever.co", "ashbyhq.com", "myworkdayjobs.com",
                          "workable.com", "smartrecruiters.com"]
PLATFORM_HOST = (r"(?i)greenhouse|lever\.co|ashbyhq|myworkdayjobs|workdayjobs|workable\.com|"
                 r"smartrecruiters|icims\.com|ultipro|successfactors|taleo|jobvite|bamboohr|"
                 r"recruitee|comeet|myworkday\.com")
LISTING_PLATFORM_HOST = PLATFORM_HOST + r"|oraclecloud\.com"
SEED_ADAPTERS = ["greenhouse", "lever", "ashby", "smartrecruiters", "workday", "workable",
                 "json_ld", "simplify"]
SEED_DOMAIN = r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+$"
SEED_TENANT = r"^[a-z0-9][a-z0-9._/-]*$"

# --- fixed values: aggregator denylist -----------------------------------------
DENIED_DOMAINS = [
    "linkedin.com", "www.linkedin.com", "indeed.com", "www.indeed.com", "glassdoor.com",
    "www.glassdoor.com", "ziprecruiter.com", "www.ziprecruiter.com", "jooble.org",
    "www.jooble.org", "monster.com", "www.monster.com", "careerbuilder.com",
    "www.careerbuilder.com", "simplyhired.com", "www.simplyhired.com", "talent.com",
    "www.talent.com", "snagajob.com", "wellfound.com", "angel.co", "builtin.com",
    "www.builtin.com", "dice.com", "www.dice.com", "flexjobs.com", "remote.co",
    "weworkremotely.com", "jobstreet.com", "seek.com.au", "totaljobs.com", "reed.co.uk",
    "naukri.com", "shine.com",
]
DENIED_PATTERNS = ["utm_source=indeed", "utm_source=linkedin", "/jobs/view/", "redirect=indeed"]

# --- fixed values: listing feed -------------------------------------------------
LISTING_CATEGORIES = ["software", "software engineering", "ai/ml/data",
                      "data science, ai & machine learning", "quant", "hardware",
                      "hardware engineering", "product", "product management"]

# --- fixed values: public filter --------------------------------------------------
EARLY_LEVELS = ["internship", "co_op", "new_grad", "entry_level", "apprenticeship",
                "graduate_program", "rotational_program", "research_internship", "fellowship",
                "student_program"]
PUBLIC_DISCIPLINES = ["software", "frontend", "backend", "full_stack", "mobile", "systems",
                      "infrastructure", "cloud", "devops", "sre", "cybersecurity", "networking",
                      "data_engineering", "data_science", "machine_learning",
                      "artificial_intelligence", "quantitative_development",
                      "quantitative_research", "hardware", "embedded", "firmware", "robotics",
                      "qa_automation", "product"]
RELEVANT_TITLE = (
    r"(?i)\b(software|engineer|developer|swe|sde|programmer|full[\s-]?stack|front[\s-]?end|"
    r"back[\s-]?end|mobile|ios|android|data|machine\s+learning|\bml\b|\bai\b|"
    r"artificial\s+intelligence|cyber|security|devops|sre|platform|cloud|systems|infrastructure|"
    r"quant(?:itative)?|trading|robotics|firmware|embedded|computer\s+science|informatics|"
    r"site\s+reliability|research\s+intern)\b")
NOISE_TITLE = (
    r"(?i)\b(technical support|support engineer|help[\s-]?desk|customer support|"
    r"business enablement|guest experience|team member|sales associate|store associate|barista|"
    r"cashier|retail)\b")
CLOSED_APPLICATIONS = (
    r"(no longer accepting(?: applications)?|applications? (?:are|have been) closed|"
    r"position (?:has been|is) filled|this (?:role|position|job) (?:has been|is) closed|"
    r"not (?:currently )?accepting applications|hiring for this role is closed)")

# --- fixed values: places -----------------------------------------------------------
US_STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California",
    "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa",
    "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland",
    "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi",
    "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire",
    "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina",
    "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania",
    "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee",
    "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington",
    "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming", "DC": "District of Columbia",
}
CA_PROVINCES = {
    "AB": "Alberta", "BC": "British Columbia", "MB": "Manitoba", "NB": "New Brunswick",
    "NL": "Newfoundland and Labrador", "NS": "Nova Scotia", "NT": "Northwest Territories",
    "NU": "Nunavut", "ON": "Ontario", "PE": "Prince Edward Island", "QC": "Quebec",
    "SK": "Saskatchewan", "YT": "Yukon",
}
# ISO 3166 alpha-2, alpha-3 and short name of the countries that occur in the rules
COUNTRIES = [
    ("US", "USA", "United States"), ("CA", "CAN", "Canada"), ("MX", "MEX", "Mexico"),
    ("GB", "GBR", "United Kingdom"), ("FR", "FRA", "France"), ("DE", "DEU", "Germany"),
    ("IE", "IRL", "Ireland"), ("NL", "NLD", "Netherlands"), ("ES", "ESP", "Spain"),
    ("IT", "ITA", "Italy"), ("SE", "SWE", "Sweden"), ("NO", "NOR", "Norway"),
    ("DK", "DNK", "Denmark"), ("FI", "FIN", "Finland"), ("CH", "CHE", "Switzerland"),
    ("AT", "AUT", "Austria"), ("BE", "BEL", "Belgium"), ("PT", "PRT", "Portugal"),
    ("PL", "POL", "Poland"), ("CZ", "CZE", "Czechia"), ("RO", "ROU", "Romania"),
    ("HU", "HUN", "Hungary"), ("GR", "GRC", "Greece"), ("IN", "IND", "India"),
    ("SG", "SGP", "Singapore"), ("JP", "JPN", "Japan"), ("CN", "CHN", "China"),
    ("KR", "KOR", "Korea, Republic of"), ("HK", "HKG", "Hong Kong"),
    ("TW", "TWN", "Taiwan, Province of China"), ("ID", "IDN", "Indonesia"),
    ("MY", "MYS", "Malaysia"), ("TH", "THA", "Thailand"), ("PH", "PHL", "Philippines"),
    ("VN", "VNM", "Viet Nam"), ("AE", "ARE", "United Arab Emirates"), ("IL", "ISR", "Israel"),
    ("AU", "AUS", "Australia"), ("NZ", "NZL", "New Zealand"), ("BR", "BRA", "Brazil"),
    ("AR", "ARG", "Argentina"), ("CL", "CHL", "Chile"), ("CO", "COL", "Colombia"),
    ("ZA", "ZAF", "South Africa"), ("NG", "NGA", "Nigeria"), ("KE", "KEN", "Kenya"),
    ("EG", "EGY", "Egypt"), ("TR", "TUR", "Türkiye"), ("UA", "UKR", "Ukraine"),
    ("EE", "EST", "Estonia"), ("LT", "LTU", "Lithuania"), ("LV", "LVA", "Latvia"),
    ("LU", "LUX", "Luxembourg"), ("BG", "BGR", "Bulgaria"), ("HR", "HRV", "Croatia"),
    ("RS", "SRB", "Serbia"), ("SK", "SVK", "Slovakia"), ("SI", "SVN", "Slovenia"),
    ("PK", "PAK", "Pakistan"), ("BD", "BGD", "Bangladesh"), ("LK", "LKA", "Sri Lanka"),
]
COUNTRY_ALIASES = {
    "united states": "US", "usa": "US", "u.s.": "US", "u.s.a.": "US", "us": "US",
    "canada": "CA", "united kingdom": "GB", "uk": "GB", "great britain": "GB", "france": "FR",
    "germany": "DE", "india": "IN", "australia": "AU", "ireland": "IE", "netherlands": "NL",
    "spain": "ES", "italy": "IT", "japan": "JP", "singapore": "SG",
}
CONTINENTS = {
    "US": "North America", "CA": "North America", "MX": "North America", "GB": "Europe",
    "FR": "Europe", "DE": "Europe", "IE": "Europe", "NL": "Europe", "ES": "Europe",
    "IT": "Europe", "SE": "Europe", "NO": "Europe", "DK": "Europe", "FI": "Europe",
    "CH": "Europe", "AT": "Europe", "BE": "Europe", "PT": "Europe", "PL": "Europe",
    "IN": "Asia", "SG": "Asia", "JP": "Asia", "CN": "Asia", "KR": "Asia", "AU": "Oceania",
    "NZ": "Oceania", "BR": "South America", "AR": "South America",
}
REGION_ALIASES = {"eu": "EU", "europe": "EU", "emea": "EMEA", "apac": "APAC", "latam": "LATAM",
                  "north america": "North America", "namer": "North America"}
REMOTE_WORDS = r"(?i)\b(remote|work from home|wfh|distributed|anywhere|telecommute)\b"
REMOTE_OR_HYBRID_WORDS = r"(?i)\b(remote|work from home|wfh|hybrid|distributed|anywhere|telecommute)\b"
HYBRID_WORDS = r"(?i)\bhybrid\b"
ONSITE_WORDS = r"\b(on[- ]site|in[- ]office|office based)\b"
WORLDWIDE_WORDS = r"(?i)\b(worldwide|global(?:ly)?|anywhere in the world)\b"
COUNTRY_LIMIT = (r"(?i)\b(?:remote\s+(?:in|within|across)\s+(?:the\s+)?)?"
                 r"(united states|usa|u\.s\.a?|canada|uk|united kingdom|india|germany|france|australia)\b"
                 r"|\b(US|CA|GB|DE|FR|IN|AU)\s+only\b")
REGION_LIMIT = (r"(?i)\b(?:remote\s+(?:in|within|across)\s+)?(?:the\s+)?"
                r"(eu|europe|emea|apac|latam|north america|namer)\b")
_ZONES = "pst|pdt|mst|mdt|cst|cdt|est|edt|utc|gmt|cet|ist|jst|aest|bst"
TIMEZONE_LIMIT = (r"(?i)\b(?:" + _ZONES + r")\b.*\b(?:timezone|hours?)\b"
                  r"|\b(?:within|overlap)\s+(?:" + _ZONES + r")\b")

# search regions
REGION_CODES = {
    "na": ["US", "CA", "MX"],
    "eu": ["GB", "IE", "FR", "DE", "NL", "ES", "IT", "SE", "NO", "DK", "FI", "CH", "AT", "BE",
           "PT", "PL", "CZ", "RO", "HU", "GR"],
    "asia": ["IN", "SG", "JP", "CN", "KR", "HK", "TW", "ID", "MY", "TH", "PH", "VN", "AE", "IL"],
}
REGION_CONTINENTS = {"na": "north america", "eu": "europe", "asia": "asia"}
REGION_WORDS = {
    "na": ["united states", "canada", "mexico"],
    "eu": ["united kingdom", "germany", "france", "ireland", "netherlands"],
    "asia": ["india", "singapore", "japan", "china", "korea"],
}
ORIGIN_ALIASES = {
    "canada": "CA", "ca": "CA", "united states": "US", "usa": "US", "us": "US", "u.s.": "US",
    "u.s.a.": "US", "america": "US", "india": "IN", "in": "IN", "united kingdom": "GB",
    "uk": "GB", "britain": "GB", "england": "GB", "gb": "GB", "germany": "DE", "de": "DE",
    "france": "FR", "fr": "FR", "australia": "AU", "au": "AU", "ireland": "IE", "ie": "IE",
    "netherlands": "NL", "nl": "NL", "singapore": "SG", "sg": "SG", "brazil": "BR", "br": "BR",
    "mexico": "MX", "mx": "MX", "japan": "JP", "jp": "JP", "china": "CN", "cn": "CN",
    "south korea": "KR", "korea": "KR", "kr": "KR",
}

# --- fixed values: pay ------------------------------------------------------------------
CURRENCY_CODES = ["USD", "EUR", "GBP", "CAD", "AUD", "JPY", "CHF", "SGD"]
# longest symbol first, so that C$ is not read as $
CURRENCY_SYMBOLS = [("C$", "CAD"), ("A$", "AUD"), ("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY")]
PAY_PERIODS = [
    ("hour", r"(?i)\b(?:per\s+)?hour(?:ly)?\b"),
    ("day", r"(?i)\b(?:per\s+)?day(?:ly)?\b"),
    ("week", r"(?i)\b(?:per\s+)?week(?:ly)?\b"),
    ("month", r"(?i)\b(?:per\s+)?month(?:ly)?\b"),
    ("year", r"(?i)\b(?:per\s+)?year(?:ly)?\b|\bannually\b|\bpa\b|\bp\.a\.\b"),
    ("internship", r"(?i)\binternship\b|\bstipend\b"),
    ("hour", r"(?i)/\s*hr\b|/\s*h\b"),
    ("year", r"(?i)/\s*yr\b|/\s*y\b"),
]
PAY_MENTION = r"(?i)(?:salary|compensation|pay)\s*[:\-]?\s*([^\n.;]{5,80})"
PAY_AMOUNT = r"(\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?)\s*([kKmM])?"

# --- fixed values: eligibility --------------------------------------------------------------
WORK_AUTHORIZATION = [
    ("us_citizen_required", r"(?i)\b(?:u\.?s\.?\s+citizen(?:ship)?|united states citizen)\b"),
    ("us_work_authorized",
     r"(?i)\b(?:authorized to work in (?:the )?u\.?s\.?|eligible to work in (?:the )?u\.?s\.?)\b"),
    ("canada_work_authorized", r"(?i)\bauthorized to work in canada\b"),
    ("uk_work_authorized", r"(?i)\bauthorized to work in (?:the )?uk\b"),
    ("eu_work_authorized", r"(?i)\bauthorized to work in (?:the )?eu\b"),
    ("no_sponsorship", r"(?i)\b(?:no sponsorship|unable to sponsor|will not sponsor)\b"),
]
ALLOWED_PLACES = (r"(?i)\b(?:must be located in|candidates in|open to candidates in|eligible in)\s+"
                  r"([a-z][a-z\s,&/]+)")
EXCLUDED_PLACES = (r"(?i)\b(?:not available (?:in|to)|excluded (?:in|for)|not open to candidates in)\s+"
                   r"([a-z][a-z\s,&/]+)")
CITIZEN_PLACES = (r"(?i)\b(?:citizens?|nationals?|residents?)\s+of\s+"
                  r"([a-z][a-z\s,&/-]+(?:and\s+[a-z][a-z\s,&/-]+)*)")
RESIDENT_PLACES = r"(?i)\b(?:must (?:be|reside|live) in|residents? of)\s+([a-z][a-z\s,&/]+)"
US_CITIZEN = r"(?i)\bu\.?s\.?\s+citizen"
CLEARANCE = r"(?i)\b(?:active\s+)?(?:secret|top secret|ts/sci|security clearance)\b"
EXPORT_CONTROL = r"(?i)\bexport control(?:led)?\b|\bitar\b|\bear99\b"
LANGUAGE = r"(?i)\b(?:fluent|proficient|native)\s+(?:in\s+)?([a-z]{3,20}(?:\s+[a-z]{3,20})?)\b"
ELIGIBILITY_COUNTRIES = {
    "united states": "US", "usa": "US", "u.s.": "US", "us": "US", "canada": "CA",
    "united kingdom": "GB", "uk": "GB", "india": "IN", "germany": "DE", "france": "FR",
    "australia": "AU", "ireland": "IE",
}

EMPLOYMENT_TYPES = {
    "full_time": "full_time", "full-time": "full_time", "full time": "full_time",
    "part_time": "part_time", "part-time": "part_time", "part time": "part_time",
    "contract": "contract", "temporary": "temporary", "internship": "internship",
    "intern": "internship",
}

# --- fixed values: curated startup companies -------------------------------------------------
STARTUPS = [
    "Y Combinator", "Resend", "PostHog", "Railway", "Render", "Doppler", "Inngest", "Trigger.dev",
    "Nango", "Prefect", "Airbyte", "Hightouch", "Metabase", "Sanity", "Mux", "LiveKit", "Docker",
    "Orca Security", "Drata", "Secureframe", "Material Security", "Replit", "Attio", "Plain",
    "Incident.io", "Apollo.io", "Fireworks AI", "Recraft", "Character.AI", "Decagon", "Poolside",
    "Mercor", "Parallel", "Descript", "Gamma", "Elicit", "Labelbox", "Lightning AI", "Saronic",
    "Nava", "Astera Labs", "IonQ", "PathAI", "Warp", "Figure", "Linear", "Vercel", "Supabase",
    "Ramp", "Notion", "Plaid", "Anthropic", "Perplexity", "Scale AI", "Mercury", "Brex",
    "Rippling", "PlanetScale", "Retool",
]

# --- turning rows into columns ------------------------------------------------------------------
_META = r"\.^$*+?{}[]|()"


def regex_escape(text: str) -> str:
    """Escape a phrase for Java and RE2 alike."""
    return "".join("\\" + c if c in _META else c for c in text)


def phrase_pattern(phrase: str, extra_edge: str = "") -> str:
    """Whole-phrase match; `extra_edge` names further characters that count as word characters."""
    edge = r"[\p{L}\p{N}_" + extra_edge + "]"
    return f"(?<!{edge}){regex_escape(phrase)}(?!{edge})"


def literal(value: object, kind: str) -> Column:
    """A rule table as one literal of the given type; the optimizer folds it to a constant."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def literal_map(mapping: dict) -> Column:
    """Small rule table (bounded by this file) as a map literal: a lookup without a join."""
    kind = "int" if mapping and isinstance(next(iter(mapping.values())), int) else "string"
    return literal(mapping, f"map<string,{kind}>")


def lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.try_element_at(literal_map(mapping), key)


@dataclass(frozen=True)
class RuleSet:
    """Bundle of rule rows an enrichment run uses; defaults to the fixed values above."""

    disciplines: list = field(default_factory=lambda: DISCIPLINES)
    career_levels: list = field(default_factory=lambda: CAREER_LEVELS)
    senior_phrases: list = field(default_factory=lambda: SENIOR_PHRASES)
    skills: list = field(default_factory=lambda: SKILLS)
    precise_terms: list = field(default_factory=lambda: PRECISE_TERMS)
    title_terms: list = field(default_factory=lambda: TITLE_TERMS)
    benefits: list = field(default_factory=lambda: BENEFITS)


RULE_SCHEMA = "family string, label string, title string, ord int, phrase int, polarity string, pattern string"
MOST_RULES = 100_000  # a rule table is configuration; more rows are an error, never cut off


def load_rules(spark: SparkSession, rules: RuleSet | None = None) -> DataFrame:
    """Every phrase as a row; `ord` numbers the labels of a family, `phrase` the phrases of a label.

    `title` is the label as it is shown, `pattern` the phrase as it is stored; order and case survive any shuffle.
    """
    r = rules or RuleSet()
    rows: list[tuple] = []

    def add(family: str, label: str, i: int, phrases: list[str], polarity: str = "positive", title: str | None = None) -> None:
        rows.extend((family, label, title or label, i, n, polarity, p) for n, p in enumerate(phrases))

    for i, (ident, label, aliases) in enumerate(r.disciplines):
        add("discipline", ident, i, [label, *aliases], title=label)
    for i, (ident, phrases) in enumerate(r.career_levels):
        add("career_level", ident, i, phrases)
    add("career_level", "unknown", len(r.career_levels), r.senior_phrases, "negative")
    for i, (ident, pattern) in enumerate(r.precise_terms):
        add("academic_term", ident, i, [pattern])
    for i, (ident, phrases) in enumerate(r.title_terms):
        add("title_term", ident, i, phrases)
    for i, (name, aliases) in enumerate(r.skills):
        add("skill", name, i, [name, *aliases])
    for i, (claim, positive, negative) in enumerate(r.benefits):
        add("benefit", claim, i, positive)
        add("benefit", claim, i, negative, "negative")
    for i, p in enumerate(PLATFORMS):
        add("platform", p.name, i, p.hosts, "positive" if p.supported else "partial")
    for i, d in enumerate(DENIED_DOMAINS):
        add("denied_domain", d, i, [d], "negative")
    for i, d in enumerate(DENIED_PATTERNS):
        add("denied_url", d, i, [d], "negative")
    return spark.createDataFrame(rows, RULE_SCHEMA)


def rule_set_from(df: DataFrame) -> RuleSet:
    """Rule rows back to a RuleSet, label by label and phrase by phrase in their stored order.

    A table of more than MOST_RULES rows is not a configuration and raises an error.
    """
    rows = df.limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"a rule table holds at most {MOST_RULES} rows")
    rows.sort(key=lambda r: (r.family, r.ord, r.polarity != "positive", r.phrase))

    def labels(family: str) -> list[tuple[str, str, list[str], list[str]]]:
        """(label, title, positive phrases, negative phrases) in their order."""
        out: dict[str, tuple] = {}
        for r in rows:
            if r.family == family:
                entry = out.setdefault(r.label, (r.label, r.title, [], []))
                entry[2 if r.polarity == "positive" else 3].append(r.pattern)
        return list(out.values())

    base = RuleSet()
    levels = labels("career_level")
    return RuleSet(
        disciplines=[(k, title, pos[1:]) for k, title, pos, _ in labels("discipline")] or base.disciplines,
        career_levels=[(k, pos) for k, _, pos, _ in levels if pos] or base.career_levels,
        senior_phrases=[p for *_, neg in levels for p in neg] or base.senior_phrases,
        skills=[(k, pos[1:]) for k, _, pos, _ in labels("skill")] or base.skills,
        precise_terms=[(k, p) for k, _, pos, _ in labels("academic_term") for p in pos] or base.precise_terms,
        title_terms=[(k, pos) for k, _, pos, _ in labels("title_term")] or base.title_terms,
        benefits=[(k, pos, neg) for k, _, pos, neg in labels("benefit")] or base.benefits,
    )


def read_rule_files(taxonomy: str, skills: str) -> RuleSet:
    """Rules from two YAML documents: disciplines and career levels, and skills with their aliases.

    Takes the documents' text; parts that a document leaves out keep the fixed values.
    """
    import yaml
    tax, known, base = yaml.safe_load(taxonomy) or {}, yaml.safe_load(skills) or {}, RuleSet()
    return RuleSet(
        disciplines=[(d["id"], d.get("label", d["id"]), list(d.get("aliases") or [])) for d in tax.get("disciplines") or []] or base.disciplines,
        career_levels=[(c["id"], list(c.get("patterns") or [])) for c in tax.get("career_levels") or []] or base.career_levels,
        skills=[(name, list((entry or {}).get("aliases") or [])) for name, entry in (known.get("skills") or {}).items()] or base.skills)
