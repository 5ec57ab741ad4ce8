"""Structured data of a page: JSON-LD, microdata and RDFa items, their errors, and what a profile of their type lacks."""

from __future__ import annotations

import json
import re

from sitequarry.sources.dom import Node, collapse

#: By type, required and recommended properties; `a|b` means one of them.
PROFILES: dict[str, tuple[str, str]] = {
    "Product": ("name offers|review|aggregateRating", "image description brand sku|gtin|gtin8|gtin12|gtin13|gtin14|mpn offers aggregateRating"),
    "ProductGroup": ("name hasVariant", "productGroupID variesBy image description brand"),
    "Offer": ("price|priceSpecification priceCurrency", "availability url priceValidUntil itemCondition shippingDetails"),
    "AggregateOffer": ("lowPrice priceCurrency", "highPrice offerCount"),
    "Article": ("headline", "image datePublished dateModified author publisher"),
    "FAQPage": ("mainEntity", ""),
    "QAPage": ("mainEntity", ""),
    "Question": ("name acceptedAnswer|suggestedAnswer", ""),
    "Answer": ("text", "url"),
    "BreadcrumbList": ("itemListElement", ""),
    "ListItem": ("position name", "item"),
    "ItemList": ("itemListElement", "numberOfItems itemListOrder"),
    "Organization": ("name url", "logo sameAs description address|contactPoint|telephone"),
    "LocalBusiness": ("name address", "telephone url image priceRange openingHoursSpecification|openingHours geo"),
    "PostalAddress": ("streetAddress addressLocality addressCountry", "postalCode addressRegion"),
    "ContactPoint": ("telephone contactType", "areaServed availableLanguage"),
    "OpeningHoursSpecification": ("dayOfWeek", "opens closes"),
    "Recipe": ("name image", "author datePublished description recipeIngredient recipeInstructions recipeYield totalTime|cookTime nutrition aggregateRating video"),
    "Event": ("name startDate location", "description endDate image offers performer organizer eventStatus eventAttendanceMode"),
    "Place": ("address", "name geo"),
    "VirtualLocation": ("url", ""),
    "Review": ("author reviewRating", "datePublished reviewBody itemReviewed publisher"),
    "Rating": ("ratingValue", "bestRating worstRating"),
    "AggregateRating": ("ratingValue ratingCount|reviewCount", "bestRating worstRating itemReviewed"),
    "VideoObject": ("name description thumbnailUrl uploadDate", "duration contentUrl|embedUrl publisher interactionStatistic expires"),
    "ImageObject": ("contentUrl|url", "license acquireLicensePage creator creditText copyrightNotice"),
    "JobPosting": ("title description datePosted hiringOrganization jobLocation|jobLocationType|applicantLocationRequirements", "baseSalary employmentType validThrough identifier directApply"),
    "MonetaryAmount": ("currency value", ""),
    "HowTo": ("name step", "image totalTime estimatedCost supply tool video"),
    "HowToStep": ("text|itemListElement", "name url image"),
    "Course": ("name description provider", "offers hasCourseInstance aggregateRating image url"),
    "SoftwareApplication": ("name offers aggregateRating|review", "applicationCategory operatingSystem"),
    "Book": ("name author", "isbn url workExample sameAs bookEdition"),
    "Movie": ("name", "image dateCreated director aggregateRating review"),
    "Person": ("name", "url image jobTitle sameAs"),
    "Brand": ("name", ""),
    "WebSite": ("name url", "potentialAction"),
    "SearchAction": ("target query-input", ""),
    "Dataset": ("name description", "license creator url distribution identifier"),
    "ProfilePage": ("mainEntity", "dateCreated dateModified"),
}
#: The subtypes that follow their parent's profile.
SUBTYPES: dict[str, str] = {
    "Article": """NewsArticle BlogPosting TechArticle ScholarlyArticle MedicalScholarlyArticle Report SatiricalArticle AdvertiserContentArticle
        LiveBlogPosting OpinionNewsArticle ReviewNewsArticle AnalysisNewsArticle BackgroundNewsArticle ReportageNewsArticle AskPublicNewsArticle""",
    "Product": "IndividualProduct ProductModel Vehicle Car Motorcycle BusOrCoach",
    "Organization": """Corporation NGO EducationalOrganization GovernmentOrganization PerformingGroup SportsOrganization SportsTeam MusicGroup
        TheaterGroup DanceGroup NewsMediaOrganization Airline Consortium FundingScheme MedicalOrganization LibrarySystem CollegeOrUniversity
        School Project ResearchProject OnlineBusiness""",
    "LocalBusiness": """Store Restaurant FoodEstablishment CafeOrCoffeeShop Bakery BarOrPub Brewery Winery Distillery FastFoodRestaurant
        IceCreamShop LodgingBusiness Hotel BedAndBreakfast Motel Resort Campground Hostel ProfessionalService LegalService Attorney Notary
        AccountingService FinancialService BankOrCreditUnion InsuranceAgency RealEstateAgent TravelAgency EmploymentAgency AutomotiveBusiness
        AutoRepair AutoDealer AutoBodyShop AutoPartsStore AutoRental AutoWash GasStation MotorcycleDealer MotorcycleRepair
        HomeAndConstructionBusiness Electrician Plumber HVACBusiness RoofingContractor GeneralContractor HousePainter Locksmith MovingCompany
        HealthAndBeautyBusiness BeautySalon HairSalon DaySpa NailSalon TattooParlor HealthClub ExerciseGym SportsActivityLocation GolfCourse
        SkiResort SwimmingPool TennisComplex BowlingAlley MedicalBusiness Dentist Physician Optician Pharmacy VeterinaryCare MedicalClinic
        DentistOffice EmergencyService FireStation PoliceStation Hospital ChildCare Preschool DryCleaningOrLaundry EntertainmentBusiness
        MovieTheater NightClub AmusementPark ArtGallery Casino ComedyClub RecyclingCenter SelfStorage ShoppingCenter
        TouristInformationCenter GovernmentOffice PostOffice Library InternetCafe ClothingStore GroceryStore HardwareStore JewelryStore
        BookStore ElectronicsStore FurnitureStore PetStore ToyStore ShoeStore SportingGoodsStore DepartmentStore ConvenienceStore LiquorStore
        MobilePhoneStore MusicStore OfficeEquipmentStore OutletStore GardenStore FloristShop HobbyShop ComputerStore TireShop WholesaleStore
        PawnShop""",
    "Event": """BusinessEvent ChildrensEvent ComedyEvent CourseInstance DanceEvent DeliveryEvent EducationEvent ExhibitionEvent Festival
        FoodEvent Hackathon LiteraryEvent MusicEvent PublicationEvent SaleEvent ScreeningEvent SocialEvent SportsEvent TheaterEvent
        VisualArtsEvent BroadcastEvent EventSeries""",
    "Review": "ClaimReview CriticReview UserReview EmployerReview MediaReview Recommendation",
    "HowToStep": "HowToSection",
    "ImageObject": "Barcode ImageObjectSnapshot",
    "SoftwareApplication": "WebApplication MobileApplication VideoGame",
    "Person": "Patient",
}
PARENT = {name: parent for parent, names in SUBTYPES.items() for name in names.split()}
#: Types that are known and have no profile.
KNOWN = frozenset(
    """
    Thing CreativeWork WebPage WebPageElement CollectionPage AboutPage ContactPage CheckoutPage ItemPage SearchResultsPage
    RealEstateListing MediaGallery ImageGallery VideoGallery Blog WPHeader WPFooter WPSideBar WPAdBlock SiteNavigationElement
    Comment Quotation Claim Table Atlas Chapter MediaObject AudioObject VideoGameClip Clip Episode TVEpisode TVSeries
    CreativeWorkSeries CreativeWorkSeason MusicAlbum MusicRecording MusicPlaylist MusicComposition PodcastEpisode PodcastSeries
    RadioEpisode Audiobook Newspaper Periodical PublicationIssue PublicationVolume Painting Sculpture Photograph GeoCoordinates
    GeoShape GeoCircle Country State City AdministrativeArea Language DefinedTerm DefinedTermSet CategoryCode CategoryCodeSet
    Occupation EmployerAggregateRating MonetaryAmountDistribution InteractionCounter StructuredValue PropertyValue
    QuantitativeValue Duration Distance Energy Mass Enumeration PriceSpecification UnitPriceSpecification
    DeliveryChargeSpecification PaymentChargeSpecification CompoundPriceSpecification OfferShippingDetails ShippingDeliveryTime
    ShippingRateSettings DefinedRegion MerchantReturnPolicy MerchantReturnPolicySeasonalOverride Audience PeopleAudience
    BusinessAudience EducationalAudience NutritionInformation RestrictedDiet HowToSupply HowToTool HowToItem HowToTip
    HowToDirection MenuItem Menu MenuSection Service GovernmentService FinancialProduct LoanOrCredit BankAccount
    InvestmentOrDeposit PaymentMethod CreditCard Trip TouristTrip TouristAttraction TouristDestination Accommodation Apartment
    House SingleFamilyResidence Residence Room HotelRoom Suite Reservation FlightReservation LodgingReservation Flight BusTrip
    TrainTrip WatchAction ViewAction ReadAction ListenAction ConsumeAction InteractAction EntryPoint Action OrderAction BuyAction
    CivicStructure Museum Park Beach Airport TrainStation BusStation SubwayStation Church PlaceOfWorship Zoo Aquarium Bridge
    Cemetery EventVenue MusicVenue StadiumOrArena PerformingArtsTheater Playground PublicToilet RVPark Landform Mountain Volcano
    BodyOfWater LandmarksOrHistoricalBuildings Continent MedicalCondition MedicalWebPage MedicalEntity AnatomicalStructure Diet
    ExercisePlan SpecialAnnouncement EducationalOccupationalCredential EducationalOccupationalProgram CourseInstance DataCatalog
    DataDownload SoftwareSourceCode ComputerLanguage APIReference Code Grant MonetaryGrant Role OrganizationRole
    ProgramMembership OwnershipInfo Demand TypeAndQuantityNode WarrantyPromise BusinessFunction ItemAvailability
    OfferItemCondition DayOfWeek GeospatialGeometry Drug DietarySupplement PropertyValueSpecification SpeakableSpecification
    SizeSpecification DeliveryTimeSettings PostalCodeRangeSpecification ArchiveComponent Certification WebContent Guide AmpStory
    ItemListOrderType MerchantReturnEnumeration ReturnFeesEnumeration PhysicalActivityCategory
    """.split()
)
MOST_ITEMS, MOST_DEPTH = 200, 12


def short_type(raw: str) -> str:
    raw = raw.strip()
    m = re.match(r"https?://(?:www\.)?schema\.org/+(.+)$", raw, re.IGNORECASE)
    if m:
        return m[1]
    head, colon, tail = raw.partition(":")
    return tail if colon and head and not re.match(r"https?:", raw, re.IGNORECASE) else raw


def profile_of(kind: str) -> str | None:
    return kind if kind in PROFILES else PARENT.get(kind)


def _has(value: object) -> bool:
    if isinstance(value, str):
        return bool(value.strip())
    if isinstance(value, list):
        return bool(value)
    return value is not None


def _missing(spec: str, node: dict) -> list[str]:
    return [" or ".join(names) for names in (s.split("|") for s in spec.split()) if not any(_has(node.get(n)) for n in names)]


def validate(types: list[str], node: dict, known: frozenset[str] = KNOWN) -> dict:
    out = {"profile": None, "status": "known-type", "missing_required": [], "missing_recommended": []}
    if not types:
        return out | {"status": "missing-type"}
    if _has(node.get("@id")) and set(node) <= {"@id", "@type", "@context"}:
        return out | {"status": "reference"}
    for kind in types:
        profile = profile_of(kind)
        if profile:
            required, recommended = (_missing(s, node) for s in PROFILES[profile])
            return out | {"profile": profile, "status": "incomplete" if required else "valid", "missing_required": required, "missing_recommended": recommended}
    return out if any(k in known for k in types) else out | {"status": "unknown-type"}


class Report:
    def __init__(self, known: frozenset[str] = KNOWN) -> None:
        self.items: list[dict] = []
        self.errors: list[dict] = []
        self.truncated = False
        self.known = known

    def add(self, form: str, types: list[str], node: dict, path: str) -> bool:
        if len(self.items) >= MOST_ITEMS:
            self.truncated = True
            return False
        self.items.append({"format": form, "types": types, "path": path} | validate(types, node, self.known))
        return True

    def error(self, kind: str, path: str) -> None:
        self.errors.append({"kind": kind, "path": path})


def _types(node: dict) -> list[str]:
    raw = node.get("@type")
    return [s for t in (raw if isinstance(raw, list) else [raw]) if isinstance(t, str) and (s := short_type(t))]


def walk_json(value: object, path: str, report: Report, depth: int = 0, top: bool = True) -> None:
    """Items of a JSON-LD value: each object with a type, or at the top or in a graph."""
    if depth > MOST_DEPTH:
        report.truncated = True
        return
    if isinstance(value, list):
        for i, v in enumerate(value):
            walk_json(v, f"{path}[{i}]", report, depth + 1, top)
    elif isinstance(value, dict):
        graph = value.get("@graph")
        if graph is not None and "@type" not in value:
            walk_json(graph, f"{path}.@graph", report, depth + 1, True)
            return
        types = _types(value)
        if "@value" not in value and (types or top):
            if not types:
                report.error("missing-type", path)
            if not report.add("json-ld", types, value, path):
                return
        for k, v in value.items():
            if k not in ("@context", "@type", "@id") and isinstance(v, dict | list):
                walk_json(v, f"{path}.{k}", report, depth + 1, k == "@graph")


def _context_error(parsed: object) -> str | None:
    first = parsed[0] if isinstance(parsed, list) and parsed else parsed
    if not isinstance(first, dict):
        return None
    context = first.get("@context")
    if context is None:
        return "missing-context"
    names = [context] if isinstance(context, str) else [c for c in context if isinstance(c, str)] if isinstance(context, list) else [str(v) for v in context.values()] if isinstance(context, dict) else []
    return None if any(re.match(r"https?://(?:www\.)?schema\.org/?", n.strip(), re.IGNORECASE) for n in names) else "invalid-context"


def json_ld(root: Node, report: Report) -> list[dict]:
    """Blocks as written, with the error of those that can't be read."""
    blocks = []
    for script in root.find("script"):
        if (script.get("type") or "").split(";")[0].strip().lower() != "application/ld+json":
            continue
        raw, path = script.text().strip(), f"$[{len(blocks)}]"
        if not raw:
            report.error("empty-block", path)
            blocks.append({"raw": raw, "parse_error": "empty"})
            continue
        try:
            parsed = json.loads(raw)
        except ValueError as e:
            report.error("malformed-json", path)
            blocks.append({"raw": raw, "parse_error": str(e)[:200]})
            continue
        if parsed in ({}, [], None):
            report.error("empty-block", path)
        elif kind := _context_error(parsed):
            report.error(kind, path)
        walk_json(parsed, path, report)
        blocks.append({"raw": raw, "parse_error": None})
    return blocks


def _value(node: Node) -> object:
    for name, attribute in (("meta", "content"), ("a", "href"), ("link", "href"), ("area", "href"), ("img", "src"), ("iframe", "src"), ("source", "src"), ("video", "src"), ("audio", "src"), ("object", "data"), ("data", "value"), ("meter", "value"), ("time", "datetime")):
        if node.name == name and node.get(attribute) is not None:
            return node.get(attribute)
    return collapse(node.text())


def microdata(root: Node, report: Report) -> None:
    by_id = {n.get("id"): n for n in root.walk() if n.get("id")}
    for k, scope in enumerate(n for n in root.walk() if "itemscope" in n.attrs):
        node: dict = {}
        if scope.get("itemid"):
            node["@id"] = scope.get("itemid")
        stack = [c for c in scope.children if isinstance(c, Node)] + [by_id[i] for i in (scope.get("itemref") or "").split() if i in by_id]
        seen = set()
        while stack:
            n = stack.pop()
            if id(n) in seen:
                continue
            seen.add(id(n))
            for prop in (n.get("itemprop") or "").split():
                node.setdefault(prop, []).append({"@type": n.get("itemtype")} if "itemscope" in n.attrs else _value(n))
            if "itemscope" not in n.attrs:
                stack.extend(c for c in n.children if isinstance(c, Node))
        node = {p: [v for v in values if _has(v)] if isinstance(values, list) else values for p, values in node.items()}
        types = [short_type(t) for t in (scope.get("itemtype") or "").split()]
        if not types:
            report.error("missing-type", f"microdata[{k}]")
        report.add("microdata", types, node, f"microdata[{k}]")


#: Prefixes of social tags, which are no schema.org data.
SOCIAL = ("og", "fb", "article", "book", "profile", "music", "video", "twitter", "product")


def rdfa(root: Node, report: Report) -> None:
    k = 0
    for n in root.walk():
        if not n.get("typeof"):
            continue
        vocab, up = "", n
        while up is not None and not vocab:
            vocab = up.get("vocab") or ""
            up = up.parent
        types = [short_type(t) for t in n.get("typeof").split() if not t.lower().startswith(tuple(f"{s}:" for s in SOCIAL))]
        if not types or not (re.match(r"https?://(?:www\.)?schema\.org", vocab, re.IGNORECASE) or any("schema" in t.lower() for t in n.get("typeof").split())):
            continue
        node: dict = {"@id": n.get("resource")} if n.get("resource") else {}
        stack = [c for c in n.children if isinstance(c, Node)]
        while stack:
            c = stack.pop()
            for prop in (c.get("property") or "").split():
                if prop.partition(":")[0].lower() not in SOCIAL:
                    value = {"@type": c.get("typeof")} if c.get("typeof") else c.get("content") or _value(c)
                    if _has(value):
                        node.setdefault(short_type(prop), []).append(value)
            if not c.get("typeof"):
                stack.extend(x for x in c.children if isinstance(x, Node))
        report.add("rdfa", types, node, f"rdfa[{k}]")
        k += 1


def report(root: Node, known: frozenset[str] = KNOWN) -> tuple[list[dict], Report]:
    out = Report(known)
    blocks = json_ld(root, out)
    microdata(root, out)
    rdfa(root, out)
    return blocks, out
