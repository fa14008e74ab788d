"""What search features' documentation asks of declared data, as tables of rules held against the records of pages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.functions import scalars
from loomgrain.operators import extract


@dataclass(frozen=True)
class Feature:
    """A feature's needs of a type: ``a|b`` is either; ``offers>price`` is asked of every value of ``offers`` that is there, ``author@Person>url``
    of those of the type, ``offers>a if b`` of those that have b, ``list>item except last`` of all but a list's last. Subtypes have their types' needs.
    """

    name: str
    types: tuple[str, ...]
    required: tuple[str, ...] = ()
    recommended: tuple[str, ...] = ()
    retired: bool = False


_RATING = ("aggregateRating>ratingValue", "aggregateRating>ratingCount|reviewCount")
_REVIEWS = ("review>author", "review>reviewRating")
#: Fixed values, from the features' public documentation.
FEATURES = (
    Feature("Product snippet", ("Product",), ("name", "review|aggregateRating|offers", "offers>price|priceSpecification|lowPrice", *_RATING, *_REVIEWS), ("aggregateRating", "offers", "review", "offers>priceCurrency|priceSpecification", "offers>availability", "offers>priceValidUntil")),
    Feature("Merchant listing", ("Product",), ("name", "image", "offers", "offers>price|priceSpecification", "offers>priceCurrency|priceSpecification"), ("brand", "description", "sku|mpn|gtin|gtin8|gtin12|gtin13|gtin14|isbn", "offers>availability", "offers>shippingDetails", "offers>hasMerchantReturnPolicy")),
    Feature("Review snippet", ("Review",), ("author", "itemReviewed", "reviewRating", "reviewRating>ratingValue"), ("datePublished", "reviewRating>bestRating", "reviewRating>worstRating")),
    Feature("Review snippet", ("AggregateRating",), ("itemReviewed", "ratingCount|reviewCount", "ratingValue"), ("bestRating", "worstRating")),
    Feature("Article", ("Article", "NewsArticle", "BlogPosting"), (), ("headline", "image", "datePublished", "dateModified", "author", "author>name", "author@Person>url", "author@Organization>url")),
    Feature("Breadcrumb", ("BreadcrumbList",), ("itemListElement", "itemListElement>position", "itemListElement>name|item", "itemListElement>item except last")),
    Feature("Organization", ("Organization", "Corporation", "OnlineStore"), (), ("name", "url", "logo", "address", "email|telephone", "sameAs")),
    Feature("Local business", ("LocalBusiness", "Restaurant", "Store", "Hotel"), ("name", "address"), ("geo", "openingHoursSpecification", "priceRange", "telephone", "url", "geo>latitude if longitude", "geo>longitude if latitude", "openingHoursSpecification>opens if closes", "openingHoursSpecification>closes if opens")),
    Feature("Recipe", ("Recipe",), ("name", "image"), ("author", "cookTime", "datePublished", "description", "nutrition", "prepTime", "recipeCategory", "recipeCuisine", "recipeIngredient", "recipeInstructions", "recipeYield", "totalTime", "video")),
    Feature("Event", ("Event", "MusicEvent", "SportsEvent", "TheaterEvent", "Festival"), ("name", "startDate", "location", "location>name|address"), ("description", "endDate", "eventStatus", "image", "offers", "organizer", "performer")),
    Feature("Job posting", ("JobPosting",), ("title", "description", "datePosted", "hiringOrganization", "jobLocation|applicantLocationRequirements"), ("baseSalary", "employmentType", "identifier", "validThrough", "applicantLocationRequirements if jobLocationType")),
    Feature("Video", ("VideoObject",), ("name", "thumbnailUrl", "uploadDate"), ("contentUrl|embedUrl", "description", "duration")),
    Feature("Software app", ("SoftwareApplication", "MobileApplication", "WebApplication"), ("name", "offers", "offers>price", "aggregateRating|review"), ("applicationCategory", "operatingSystem")),
    Feature("Course list", ("Course",), ("name", "description"), ("provider",)),
    Feature("Dataset", ("Dataset",), ("name", "description"), ("creator", "license", "distribution", "identifier", "temporalCoverage", "spatialCoverage", "distribution>contentUrl")),
    Feature("Q&A page", ("QAPage",), ("mainEntity", "mainEntity>name|text", "mainEntity>answerCount", "mainEntity>acceptedAnswer|suggestedAnswer"), ()),
    Feature("Discussion forum", ("DiscussionForumPosting", "SocialMediaPosting"), ("author", "datePublished", "text|image|video"), ("author>url", "headline", "url")),
    Feature("Profile page", ("ProfilePage",), ("mainEntity", "mainEntity>name"), ("dateCreated", "dateModified", "mainEntity>image")),
    Feature("Site name", ("WebSite",), ("name", "url"), ("alternateName",)),
    Feature("FAQ", ("FAQPage",), ("mainEntity", "mainEntity>name", "mainEntity>acceptedAnswer"), ()),
    Feature("Image metadata", ("ImageObject",), ("contentUrl", "creator|creditText|copyrightNotice|license"), ("acquireLicensePage",)),
    Feature("Vacation rental", ("VacationRental",), ("name", "image", "identifier", "latitude|geo", "containsPlace"), ("address", "aggregateRating", "brand", "checkinTime", "checkoutTime")),
    Feature("Movie", ("Movie",), ("name", "image"), ("aggregateRating", "dateCreated", "director", "review")),
    Feature("How-to", ("HowTo",), retired=True),
    Feature("Sitelinks search box", ("SearchAction",), retired=True),
    Feature("Fact check", ("ClaimReview",), retired=True),
    Feature("Special announcement", ("SpecialAnnouncement",), retired=True),
)


#: Types of schema.org below those that features name, as ``type: subtypes``.
_SUBTYPES = """
Article: AdvertiserContentArticle NewsArticle Report SatiricalArticle ScholarlyArticle SocialMediaPosting TechArticle
NewsArticle: AnalysisNewsArticle AskPublicNewsArticle BackgroundNewsArticle OpinionNewsArticle ReportageNewsArticle ReviewNewsArticle
SocialMediaPosting: BlogPosting DiscussionForumPosting
BlogPosting: LiveBlogPosting
Review: ClaimReview CriticReview EmployerReview MediaReview Recommendation UserReview
AggregateRating: EmployerAggregateRating
Product: DietarySupplement Drug IndividualProduct ProductCollection ProductGroup ProductModel SomeProducts Vehicle
Vehicle: BusOrCoach Car Motorcycle MotorizedBicycle
Person: Patient
Organization: Airline Consortium Cooperative Corporation EducationalOrganization FundingScheme GovernmentOrganization LibrarySystem LocalBusiness MedicalOrganization NGO NewsMediaOrganization OnlineBusiness PerformingGroup PoliticalParty Project ResearchOrganization SearchRescueOrganization SportsOrganization WorkersUnion
OnlineBusiness: OnlineStore
EducationalOrganization: CollegeOrUniversity ElementarySchool HighSchool MiddleSchool Preschool School
LocalBusiness: AnimalShelter ArchiveOrganization AutomotiveBusiness ChildCare Dentist DryCleaningOrLaundry EmergencyService EmploymentAgency EntertainmentBusiness FinancialService FoodEstablishment GovernmentOffice HealthAndBeautyBusiness HomeAndConstructionBusiness InternetCafe LegalService Library LodgingBusiness MedicalBusiness ProfessionalService RadioStation RealEstateAgent RecyclingCenter SelfStorage ShoppingCenter SportsActivityLocation Store TelevisionStation TouristInformationCenter TravelAgency
AutomotiveBusiness: AutoBodyShop AutoDealer AutoPartsStore AutoRental AutoRepair AutoWash GasStation MotorcycleDealer MotorcycleRepair
FinancialService: AccountingService AutomatedTeller BankOrCreditUnion InsuranceAgency
FoodEstablishment: Bakery BarOrPub Brewery CafeOrCoffeeShop Distillery FastFoodRestaurant IceCreamShop Restaurant Winery
HealthAndBeautyBusiness: BeautySalon DaySpa HairSalon HealthClub NailSalon TattooParlor
HomeAndConstructionBusiness: Electrician GeneralContractor HVACBusiness HousePainter Locksmith MovingCompany Plumber RoofingContractor
LegalService: Attorney Notary
LodgingBusiness: BedAndBreakfast Campground Hostel Hotel Motel Resort VacationRental
Store: BikeStore BookStore ClothingStore ComputerStore ConvenienceStore DepartmentStore ElectronicsStore Florist FurnitureStore GardenStore GroceryStore HardwareStore HobbyShop HomeGoodsStore JewelryStore LiquorStore MensClothingStore MobilePhoneStore MovieRentalStore MusicStore OfficeEquipmentStore OutletStore PawnShop PetStore ShoeStore SportingGoodsStore TireShop ToyStore WholesaleStore
Event: BusinessEvent ChildrensEvent ComedyEvent CourseInstance DanceEvent DeliveryEvent EducationEvent EventSeries ExhibitionEvent Festival FoodEvent Hackathon LiteraryEvent MusicEvent PublicationEvent SaleEvent ScreeningEvent SocialEvent SportsEvent TheaterEvent VisualArtsEvent
SoftwareApplication: MobileApplication VideoGame WebApplication
ImageObject: Barcode ImageObjectSnapshot
Dataset: DataFeed
"""


def below(root: str) -> tuple[str, ...]:
    """A type and all below it."""
    tree = dict(line.split(": ") for line in _SUBTYPES.strip().splitlines())
    found, stack = {}, [root]
    while stack:
        t = stack.pop()
        if t not in found:
            found[t] = None
            stack += tree.get(t, "").split()
    return tuple(found)


_NEED = re.compile(r"(?:(?P<under>\w+)(?:@(?P<of>\w+))?>)?(?P<options>[\w|]+)(?: if (?P<when>\w+))?(?P<last> except last)?")


def _rules() -> list[tuple]:
    """A row for every need and type, subtypes too: feature, type, level (required, recommended, or ``retired`` for what is no longer shown), under, of (types), options, when and but_last."""
    rows = []
    for f in FEATURES:
        for t in dict.fromkeys(x for root in f.types for x in below(root)):
            for level, needs in (("required", f.required), ("recommended", f.recommended)):
                for need in needs:
                    m = _NEED.fullmatch(need)
                    rows.append((f.name, t, level, m["under"] or "", tuple(below(m["of"])) if m["of"] else (), tuple(m["options"].split("|")), m["when"] or "", m["last"] is not None))
            if f.retired:
                rows.append((f.name, t, "retired", "", (), (), "", False))
    return rows


@lru_cache(maxsize=1)
def _by_type() -> dict[str, list[tuple]]:
    """The rules of each type, without it."""
    found: dict[str, list[tuple]] = {}
    for feature, kind, *need in _rules():
        found.setdefault(kind, []).append((feature, *need))
    return found


_TOP = re.compile(r"[^.\[]+(?:\[[0-9]+\])?")
_PLACE = re.compile(r"\[([0-9]+)\]$")


def lacking(types: list[str], fields: list[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """feature, level, under and options of every need that a record with such types and fields (key, text or JSON) doesn't meet."""
    # two types of a record may share a need
    needs = dict.fromkeys(need for t in types for need in _by_type().get(t, ()) if need[1] != "retired")
    held = [x for key, value in fields for x in extract.texts_of(key, value)] if needs else []
    if not held:
        return []
    typed = {f"{p[:-6]}={re.sub(r'^.*[/:]', '', leaf)}" for p, leaf in held if p.endswith(".@type")}
    there = {p for p, _ in held} | {p[: m.start()] for p, _ in held for m in re.finditer(r"[.\[]", p)}
    tops: dict[str, list[tuple[str, int]]] = {}
    for top in dict.fromkeys(m[0] for p, _ in held if (m := _TOP.match(p))):
        at = _PLACE.search(top)
        tops.setdefault(top[: at.start()] if at else top, []).append((top, int(at[1]) if at else 0))
    out = []
    for feature, level, under, of, options, when, but_last in needs:
        inside = tops.get(under, []) if under else [("", 0)]
        last = max((k for _, k in inside), default=0)
        for u, k in inside:
            if under and (of and not any(f"{u}={t}" in typed for t in of) or but_last and k >= last):
                continue
            start = f"{u}." if under else ""
            if (not when or start + when in there) and not any(start + o in there for o in options):
                out.append((feature, level, u, "|".join(options)))
    return out


def verdicts(types: list[str], fields: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """feature and verdict of each feature that a record with such types and fields is for."""
    known: dict[str, bool] = {}
    for feature, level, *_ in (need for t in types for need in _by_type().get(t, ())):
        known[feature] = known.get(feature, False) or level == "retired"
    lacks: dict[str, bool] = {}
    for feature, level, _, _ in lacking(types, fields):
        lacks[feature] = lacks.get(feature, False) or level == "required"
    return [(f, "retired" if retired else "complete" if f not in lacks else "ineligible" if lacks[f] else "improvable") for f, retired in known.items()]


def _of_records(extracted: DataFrame, one: Callable[[list, list], list[tuple]], names: tuple[str, ...]) -> DataFrame:
    """page_id, ix and ``names`` of what ``one`` says of each record's types and fields."""
    schema = pa.schema([("page_id", pa.int64()), ("ix", pa.int32()), *((n, pa.string()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                pages = zip(*(batch.slice(k, 500).column(c).to_pylist() for c in range(2)), strict=True)
                rows = [(page, r["ix"], *x) for page, records in pages for r in records or [] for x in one(r["types"] or [], [(f["key"], f["value"]) for f in r["fields"] or []])]
                columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return extracted.select("page_id", "records").mapInArrow(run, f"page_id long, ix int, {', '.join(f'{n} string' for n in names)}")


def missing(extracted: DataFrame) -> DataFrame:
    """page_id, ix, feature, level, under (the value that lacks it, with its place in a list) and options of every need that a record doesn't meet.

    A record stays in its page's row and is held against the rules there: no join, and one parse of a page.
    """
    return _of_records(extracted, lacking, ("feature", "level", "under", "options"))


def features(extracted: DataFrame) -> DataFrame:
    """page_id, ix, feature and verdict of each record that a feature is for: retired, ineligible (a required property is missing), improvable or complete."""
    return _of_records(extracted, verdicts, ("feature", "verdict"))


_NUMBER = r"^-?\d+(?:\.\d+)?$"
_INSTANT = r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
_DURATION = r"^P(?=\d|T\d)(?:\d+Y)?(?:\d+M)?(?:\d+W)?(?:\d+D)?(?:T(?=\d)(?:\d+H)?(?:\d+M)?(?:\d+(?:[.,]\d+)?S)?)?$"
#: Terms of schema.org's enumerations.
_ENUMS = {
    "availability": "BackOrder Discontinued InStock InStoreOnly LimitedAvailability MadeToOrder OnlineOnly OutOfStock PreOrder PreSale Reserved SoldOut",
    "itemCondition": "DamagedCondition NewCondition RefurbishedCondition UsedCondition",
    "eventStatus": "EventCancelled EventMovedOnline EventPostponed EventRescheduled EventScheduled",
    "eventAttendanceMode": "MixedEventAttendanceMode OfflineEventAttendanceMode OnlineEventAttendanceMode",
}
_KINDS = {
    "price": "price lowPrice highPrice", "currency": "priceCurrency currency",
    "date": "availabilityEnds availabilityStarts dateCreated dateModified datePosted datePublished endDate expires foundingDate priceValidUntil startDate uploadDate validFrom validThrough",
    "duration": "cookTime duration prepTime timeRequired totalTime", "url": "contentUrl embedUrl image item logo menu sameAs thumbnailUrl url",
    "count": "ratingCount reviewCount offerCount answerCount commentCount", "number": "ratingValue bestRating worstRating", "position": "position",
    "gtin": "gtin gtin8 gtin12 gtin13 gtin14", "latitude": "latitude", "longitude": "longitude",
}


def wrong_values(paths: DataFrame) -> DataFrame:
    """page_id, ix, path, value, check of leaves whose text isn't what their property holds. ``paths`` is extract.paths()'s."""
    p, v = F.regexp_replace(F.regexp_extract("path", r"([^.]+)$", 1), r"\[\d+\]$", ""), F.trim("leaf")
    known = {name: kind for kind, names in _KINDS.items() for name in names.split()} | {name: "enumeration" for name in _ENUMS}
    check = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[p]
    term = F.regexp_replace(v, r"^(?:https?://(?:www\.)?schema\.org/|schema:)", "")
    enum = reduce(lambda a, b: a | b, ((F.col("property") == n) & term.isin(*terms.split()) for n, terms in _ENUMS.items()))
    between = lambda low, high: v.try_cast("double").between(low, high)
    day = F.substring(v, 1, 10).try_cast("date").isNotNull()
    good = (
        F.when(F.col("check").isin("price", "number"), v.rlike(_NUMBER))
        .when(F.col("check") == "currency", v.isin(*scalars.CODES))
        .when(F.col("check") == "date", v.rlike(_INSTANT) & day)
        .when(F.col("check") == "duration", v.rlike(_DURATION))
        .when(F.col("check") == "url", v.rlike(r"(?i)^https?://[^\s/?#]+"))
        .when(F.col("check") == "count", v.rlike(r"^\d+$"))
        .when(F.col("check") == "position", v.rlike(r"^[1-9]\d*$"))
        .when(F.col("check") == "gtin", scalars.gtin(v).isNotNull())
        .when(F.col("check") == "latitude", F.coalesce(between(-90, 90), F.lit(False)))
        .when(F.col("check") == "longitude", F.coalesce(between(-180, 180), F.lit(False)))
        .otherwise(enum)
    )
    held = paths.select("page_id", "ix", "path", "leaf", p.alias("property"), check.alias("check")).where("check is not null")
    return held.where(~good).select("page_id", "ix", "path", F.col("leaf").alias("value"), "check")


_COMPARED = ("name", "price", "priceCurrency", "availability", "datePublished", "dateModified", "sku", "ratingValue")


def contradictions(items: DataFrame) -> DataFrame:
    """page_id, type, fact, one, other: a fact that two vocabularies state differently about a type that each of them has once.

    ``items`` is declared.items()'s (page_id, reader, ix, types, json). A self-join on page and type, of single items only.
    """
    each = items.select("page_id", "reader", F.explode("types").alias("type"), "json")
    single = each.groupBy("page_id", "reader", "type").agg(F.count("*").alias("n"), F.first("json").alias("json")).where("n = 1")
    offer = lambda f: F.coalesce(F.get_json_object("json", f"$.{f}"), F.get_json_object("json", f"$.offers.{f}"), F.get_json_object("json", f"$.aggregateRating.{f}"))
    facts = single.select("page_id", "reader", "type", F.explode(F.array(*(F.struct(F.lit(f).alias("fact"), offer(f).alias("value")) for f in _COMPARED))).alias("x")).select("page_id", "reader", "type", "x.fact", "x.value").where("value is not null")
    v, f = F.col("value"), F.col("fact")
    meaning = F.when(f.isin("price", "ratingValue"), scalars.amount(v).try_cast("decimal(38,10)").cast("string")).when(f.startswith("date"), F.substring(scalars.iso_date(v), 1, 10)).when(f == "availability", F.regexp_replace(v, r"^.*[/:]", "")).otherwise(F.lower(F.trim(F.regexp_replace(v, r"\s+", " "))))
    facts = facts.withColumn("meaning", meaning).where("meaning is not null")
    both = facts.groupBy("page_id", "type", "fact").agg(F.array_sort(F.collect_list(F.struct("reader", "value", "meaning"))).alias("said"))
    differ = both.where(F.size(F.array_distinct(F.transform("said", lambda x: x["meaning"]))) > 1)
    other = F.get(F.filter("said", lambda x: x["meaning"] != F.col("said")[0]["meaning"]), F.lit(0))
    return differ.select("page_id", "type", "fact", F.col("said")[0]["value"].alias("one"), other["value"].alias("other"))


def page_findings(parsed: DataFrame) -> DataFrame:
    """page_id, code and value of what a page lacks or says twice: title, description, canonical, OpenGraph's four. ``parsed`` is declared.parse()'s."""
    content = lambda m: F.trim(F.coalesce(m["content"], F.lit("")))
    described = F.exists("metas", lambda m: (F.lower(F.trim(F.coalesce(m["name"], F.lit("")))) == "description") & (content(m) != ""))
    og = lambda *keys: F.exists("metas", lambda m: F.lower(F.trim(F.coalesce(m["property"], m["name"], F.lit("")))).isin(*(f"og:{k}" for k in keys)) & (content(m) != ""))
    canonical = F.filter("links", lambda x: (x["tag"] == "link") & x["in_head"] & F.array_contains(F.split(F.lower(F.coalesce(x["rel"], F.lit(""))), r"\s+"), "canonical") & (F.trim(F.coalesce(x["href"], F.lit(""))) != ""))
    hrefs = F.array_distinct(F.transform(canonical, lambda x: F.trim(x["href"])))
    found = lambda when, code, value=None: F.when(when, F.struct(F.lit(code).alias("code"), (F.lit(None).cast("string") if value is None else value).alias("value")))
    relative = F.filter(hrefs, lambda h: ~h.rlike(r"(?i)^https?://"))
    each = F.array(
        found(F.coalesce(F.trim("title"), F.lit("")) == "", "missing-title"),
        found(~F.coalesce(described, F.lit(False)), "missing-description"),
        found(F.size(hrefs) == 0, "missing-canonical"),
        found(F.size(hrefs) > 1, "canonicals-disagree", F.get(hrefs, F.lit(1))),
        found(F.size(relative) > 0, "canonical-relative", F.get(relative, F.lit(0))),
        *(found(~F.coalesce(og(*keys.split()), F.lit(False)), "missing-opengraph", F.lit(f"og:{keys.split()[0]}")) for keys in ("title", "type", "image image:url image:secure_url", "url")),
    )
    return parsed.select("page_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f")).select("page_id", "f.code", "f.value")


#: Crawlers that feed models or answers, by what they are for.
AGENTS = {
    "training": "gptbot claudebot google-extended applebot-extended ccbot bytespider meta-externalagent amazonbot cohere-training-data-crawler diffbot omgili ai2bot",
    "search": "oai-searchbot claude-searchbot perplexitybot googlebot bingbot duckassistbot youbot",
    "user": "chatgpt-user claude-user perplexity-user meta-externalfetcher mistralai-user",
}


def crawler_verdicts(rules: DataFrame) -> DataFrame:
    """site, agent, purpose, allowed (may it read the front page) and named (does the file speak of it). ``rules`` is robots_rules()'s."""
    said = rules.where("agent <> ''").groupBy("site").agg(F.collect_set(F.struct("agent", "kind", "value")).alias("said"))
    # a fixed list of agents for each site, expanded within the site's row
    each = said.select("site", "said", F.explode(F.array(*(F.struct(F.lit(a).alias("agent"), F.lit(p).alias("purpose")) for p, names in AGENTS.items() for a in names.split()))).alias("a")).select("site", "said", "a.*")
    mine = F.filter("said", lambda x: (x["agent"] != "*") & F.col("agent").startswith(x["agent"]))
    best = F.array_max(F.transform(mine, lambda x: F.struct(F.length(x["agent"]).alias("n"), x["agent"].alias("agent"))))["agent"]
    held = F.filter("said", lambda x: x["agent"] == F.coalesce(F.col("best"), F.lit("*")))
    fits = F.filter(held, lambda x: x["kind"].isin("allow", "disallow") & x["value"].isin("/", "/*", "*", "/$"))
    verdict = F.array_max(F.transform(fits, lambda x: F.struct(F.length(x["value"]).alias("n"), (x["kind"] == "allow").alias("allow"))))["allow"]
    return each.withColumn("best", best).select("site", "agent", "purpose", F.coalesce(verdict, F.lit(True)).alias("allowed"), F.col("best").isNotNull().alias("named"))


def llms_txt(files: DataFrame) -> DataFrame:
    """site, ord, section, name, address, note of the links of llms.txt texts; a file without a first-level heading gives none."""
    lines = files.where(F.col("text").rlike(r"(?m)^# \S")).select("site", F.posexplode(F.split("text", r"\r?\n")).alias("ord", "line"))
    section = F.last(F.when(F.col("line").rlike(r"^## "), F.trim(F.substring("line", 4, 1000))), ignorenulls=True).over(Window.partitionBy("site").orderBy("ord"))
    link = r"^\s*[-*]\s*\[([^\]]*)\]\(([^)\s]+)\)\s*:?\s*(.*)$"
    rows = lines.withColumn("section", section).where(F.col("line").rlike(link))
    return rows.select("site", "ord", "section", F.regexp_extract("line", link, 1).alias("name"), F.regexp_extract("line", link, 2).alias("address"), F.regexp_extract("line", link, 3).alias("note"))


def llms_findings(files: DataFrame) -> DataFrame:
    """site, code and value of what is amiss in llms.txt texts: ``no-title``, ``no-summary``, ``second-title``, ``bad-link`` (a list item of a section that is none), ``relative-link``, ``repeated-link``, ``empty-section``.

    A file is a few kilobytes by nature and stays one row.
    """
    lines = F.split(F.coalesce("text", F.lit("")), r"\r?\n")
    held = files.select("site", F.filter(lines, lambda x: F.trim(x) != "").alias("lines"))
    titles = F.filter("lines", lambda x: x.rlike(r"^# \S"))
    items = F.filter(F.transform("lines", lambda x, i: F.struct(x.alias("line"), i.alias("i"))), lambda x: x["line"].rlike(r"^\s*[-*]\s") & (x["i"] > F.col("first_section")))
    link = r"^\s*[-*]\s*\[([^\]]*)\]\(([^)\s]+)\)"
    t = held.withColumn("first_section", F.coalesce(F.array_min(F.filter(F.transform("lines", lambda x, i: F.when(x.rlike("^## "), i)), lambda i: i.isNotNull())), F.lit(1 << 30)))
    t = t.withColumn("items", items).withColumn("addresses", F.transform(F.filter("items", lambda x: x["line"].rlike(link)), lambda x: F.regexp_extract(x["line"], link, 2)))
    one = lambda when, code, value=None: F.when(when, F.array(F.struct(F.lit(code).alias("code"), (F.lit(None).cast("string") if value is None else value).alias("value"))))
    many = lambda values, code: F.transform(values, lambda v: F.struct(F.lit(code).alias("code"), v.alias("value")))
    empty = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike("^## ") & ~F.coalesce(F.get("lines", i + 1).rlike(r"^(?!##? )"), F.lit(False)), F.trim(F.substring(x, 4, 1000)))), lambda x: x.isNotNull())
    repeated = F.array_distinct(F.filter("addresses", lambda a: F.size(F.filter("addresses", lambda b: a == b)) > 1))
    found = F.flatten(F.filter(F.array(
        one(F.size(titles) == 0, "no-title"), one(~F.exists("lines", lambda x: x.rlike(r"^> \S")), "no-summary"), one(F.size(titles) > 1, "second-title", F.get(titles, F.lit(1))),
        many(F.transform(F.filter("items", lambda x: ~x["line"].rlike(link)), lambda x: F.trim(x["line"])), "bad-link"), many(F.filter("addresses", lambda a: ~a.rlike("(?i)^https?://")), "relative-link"), many(repeated, "repeated-link"), many(empty, "empty-section"),
    ), lambda x: x.isNotNull()))
    return t.select("site", F.explode(found).alias("f")).select("site", "f.code", "f.value")
