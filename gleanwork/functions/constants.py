"""Fixed values. They decide results and are stated as they are, in their natural order."""

LEGAL_SUFFIXES = r"\b(ltd|limited|llc|l\.l\.c|inc|incorporated|llp|l\.l\.p|pvt|private|plc|corp|corporation|co|company|gmbh|ag|sa|s\.a|pte|sdn|bhd|bv|b\.v|nv|pty|pllc|pc|p\.c|lp|group|holdings?)\b\.?"
SECOND_LEVEL = "co com org net gov ac edu gen firm ltd plc nic or ne biz info".split()
SKIP_DOMAINS = """
google.com bing.com duckduckgo.com yahoo.com baidu.com facebook.com twitter.com x.com linkedin.com instagram.com youtube.com tiktok.com
pinterest.com reddit.com quora.com wikipedia.org wikimedia.org wiktionary.org britannica.com amazon.com apple.com microsoft.com adobe.com
wordpress.com wordpress.org blogspot.com tumblr.com medium.com github.com glassdoor.com indeed.com ambitionbox.com naukri.com monster.com
ziprecruiter.com simplyhired.com yelp.com yellowpages.com bbb.org crunchbase.com zoominfo.com dnb.com bloomberg.com forbes.com inc.com
investopedia.com statista.com nerdwallet.com bankrate.com clutch.co goodfirms.co designrush.com sortlist.com themanifest.com expertise.com
upcity.com g2.com capterra.com trustpilot.com justdial.com sulekha.com indiamart.com tradeindia.com europages.com kompass.com thomasnet.com
manta.com chamberofcommerce.com cylex.com hotfrog.com brownbook.net yell.com thomsonlocal.com lawyers.com avvo.com findlaw.com justia.com
martindale.com legal500.com chambers.com superlawyers.com healthgrades.com webmd.com zocdoc.com vitals.com practo.com behance.net
artstation.com dribbble.com vimeo.com wikihow.com linktr.ee archive.org sec.gov gov.uk cloudflare.com godaddy.com wix.com squarespace.com
shopify.com hubspot.com mailchimp.com salesforce.com gartner.com mckinsey.com coursera.org udemy.com fortune.com builtin.com
fintechmagazine.com wikimediafoundation.org prospects.ac.uk bcgsearch.com businessinsider.com cnbc.com reuters.com wsj.com nytimes.com
theguardian.com ft.com economictimes.com indiatimes.com moneycontrol.com livemint.com techcrunch.com entrepreneur.com hbr.org vault.com
fool.com marketwatch.com msn.com cnn.com bbc.com bbc.co.uk thebalancemoney.com smartasset.com zippia.com comparably.com owler.com
cbinsights.com pitchbook.com tracxn.com f6s.com startupranking.com growjo.com rocketreach.co apollo.io signalhire.com lusha.com
sciencedirect.com researchgate.net springer.com nature.com ncbi.nlm.nih.gov who.int un.org worldbank.org imf.org oecd.org europa.eu
ebay.com alibaba.com aliexpress.com etsy.com walmart.com target.com craigslist.org gumtree.com olx.in 99acres.com magicbricks.com
ranker.com softwaresuggest.com goodreads.com slideshare.net
""".split()
AGGREGATOR_DOMAINS = """
clutch.co goodfirms.co designrush.com sortlist.com themanifest.com expertise.com upcity.com g2.com capterra.com yelp.com yellowpages.com
justdial.com sulekha.com indiamart.com europages.com kompass.com thomasnet.com manta.com hotfrog.com cylex.com yell.com legal500.com
chambers.com findlaw.com martindale.com superlawyers.com avvo.com healthgrades.com behance.net artstation.com wikipedia.org forbes.com
inc.com crunchbase.com bbb.org trustpilot.com medium.com reddit.com quora.com glassdoor.com
""".split()
MEDIA_DOMAIN = r"(^|[.\-])(news|magazine|mag|wiki|forum|forums|tribune|gazette|herald|journal|times|daily|weekly|press|insider|ranking|rankings|top10|toplist|listing|listings|directory|awards)([.\-]|$)"
MEDIA_NAME = r"\b(magazine|news|forum|wiki|wikipedia|foundation|university|college|institute of technology|tribune|gazette|herald|journal|times|encyclopedia|dictionary|top \d+|best \d+|\d+ best|rankings?|blog)\b"
JUNK_NAME = r"\b(how to|what is|guide to|list of|jobs? in|vacancy|vacancies|login|sign ?up|error|untitled)\b"
BLOCKED_TITLE = r"client challenge|just a moment|attention required|access denied|are you a human|verify you are|captcha|403 forbidden|404|not found|page not found|error \d{3}|service unavailable|site not found|domain (?:is )?for sale|parked domain|coming soon|under construction|account suspended|bot detection|security check|please wait"
EMAIL = r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,4}\.[A-Za-z]{2,12}"
BAD_EMAIL_PARTS = "example. sentry wixpress domain.com email.com yourdomain @2x .png .jpg .jpeg .gif .svg .webp schema.org w3.org noreply no-reply donotreply @sentry your@ name@ user@ @test. @localhost jquery bootstrap".split()
PHONE = r"(?<![\w/#])(?:\+\s?\d{1,3}[\s.\-]?)?(?:\(\s?\d{1,5}\s?\)|\d{1,5})(?:[\s.\-]?\d{2,5}){2,4}(?![\w])"
DATE_LIKE = r"^\d{1,4}[./\-\s]+\d{1,2}[./\-\s]+\d{1,4}$"
YEAR_RANGE = r"^(19|20)\d{2}\s*[-–.]\s*(19|20)\d{2}$"
TITLE_PARTS = ["home", "homepage", "home page", "welcome", "index", "official site", "official website", "main page", "start", "untitled", "contact", "contact us", "about", "about us", "services", "our services"]
COUNTRIES = [
    "india", "usa", "united states", "united states of america", "uk", "united kingdom", "canada", "australia", "uae", "united arab emirates", "singapore", "ireland", "germany", "netherlands",
    "south africa", "new zealand", "philippines", "malaysia", "hong kong", "switzerland", "france", "spain", "italy", "sweden", "poland", "saudi arabia", "qatar", "nigeria", "kenya", "japan", "china",
    "indonesia", "thailand", "brazil", "mexico", "belgium", "austria", "denmark", "norway", "finland", "portugal",
]
POSTCODE = r"\b\d{4,7}(?:[-\s]\d{3,4})?\b"
FILLER_WORDS = "in the a an of for and near me top best leading trusted boutique independent professional specialist local rated reputable affordable list &".split()
BUSINESS_NOUNS = "company firm agency service provider studio business office group solution specialist expert shop".split()
CONTACT_LINK = r"contact|about|reach-?us|get-?in-?touch|locations?|offices?|find-?us|visit-?us"
SEQUENTIAL_DIGITS = ["1234567890", "0123456789", "9876543210"]
PHONE_CONTEXT = r"tel|phone|call|mob|whatsapp|contact|ph\b|dial|hotline|toll"
ADDRESS_CLASS = r"(^|[\s_\-])(address|addr|location|office)([\s_\-]|$)"
ADDRESS_WORD = (
    r"\b(street|st\.|road|rd\.|avenue|ave\.?|suite|ste\.|floor|fl\.|building|bldg|blvd|boulevard|lane|ln\.|drive|dr\.|plaza|tower|towers|sector|nagar|"
    r"park|way|square|centre|center|complex|house|block|estate|unit|level|po box|p\.o\. box|highway|hwy|court|ct\.|place|pl\.|marg|colony|"
    r"industrial|business park|tech park)\b"
)
SERVICE_LINK = r"service|solution|practice|expertise|what-we-do|offering|capabilit|specialt|industr|product|portfolio"
GENERIC_LINK_TEXT = [
    "services", "our services", "solutions", "our solutions", "read more", "learn more", "view all", "more", "home", "about", "about us", "contact",
    "contact us", "products", "industries", "view more", "see all", "explore", "get started", "click here", "here", "menu", "login", "sign in",
]
ORGANISATION_TYPES = "organization localbusiness corporation professionalservice legalservice financialservice medicalorganization medicalbusiness employmentagency accountingservice dentist physician hospital store attorney insuranceagency homeandconstructionbusiness healthandbeautybusiness".split()
GENERIC_WORDS = "companies company firms firm agencies agency services service providers provider studios studio business businesses the of and in".split()
EXPANSION_SUFFIXES = ["consultants", "contractors", "services company"]
QUERY_MODIFIERS = ["top", "best", "leading", "trusted", "boutique", "independent", "professional", "specialist"]
TITLE_SPLIT = r"\s+[\|\-–—:•·»«/]\s+|\s+[\|•·»«]\s*|\s*[\|•·»«]\s+"
TITLE_EDGE = " -|:•·»"
