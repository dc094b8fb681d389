"""Small domain rows of our own for matcher tests."""

POSTINGS = (
    "job_id long, scope string, title string, company string, location string, description string, "
    "employment_type string, work_arrangement string"
)
REQUIREMENTS = (
    "job_id long, role_family string, seniority_level string, industry string, required_skills array<string>, "
    "preferred_skills array<string>, required_education array<string>, preferred_education array<string>, "
    "min_years int, max_years int, responsibilities array<string>, certifications array<string>, "
    "work_authorization string, hard_disqualifiers array<string>, notes string"
)
PROFILES = (
    "profile_id long, scope string, full_name string, education_summary string, target_roles array<string>, "
    "target_industries array<string>, skills array<string>, experience_level string, "
    "preferred_locations array<string>, preferred_arrangement string, preferred_employment string, "
    "work_authorization string, priorities array<string>, deal_breakers array<string>, additional_context string"
)


def posting(job_id, title, location="", description="", employment="full_time", arrangement="hybrid"):
    return (job_id, "all", title, "Helix", location, description, employment, arrangement)


def requirement(job_id, **given):
    base = {
        "role_family": "", "seniority_level": "unknown", "industry": "", "required_skills": [],
        "preferred_skills": [], "required_education": [], "preferred_education": [], "min_years": None,
        "max_years": None, "responsibilities": [], "certifications": [], "work_authorization": "",
        "hard_disqualifiers": [], "notes": "",
    }
    base.update(given)
    return (job_id, *base.values())


def profile(profile_id=1, **given):
    base = {
        "scope": "all", "full_name": "Sam", "education_summary": "BSc in Biomedical Engineering. Minor in statistics",
        "target_roles": ["Systems Engineer", "Test Engineer"], "target_industries": ["Medical devices"],
        "skills": ["Python", "Test protocols", "ISO 13485 basics", "automated regression testing of scripts"],
        "experience_level": "entry_level", "preferred_locations": ["Boston, MA", "Remote - US"],
        "preferred_arrangement": "hybrid", "preferred_employment": "full_time", "work_authorization": "",
        "priorities": ["learn firmware"], "deal_breakers": [], "additional_context": "Built a Django web application",
    }
    base.update(given)
    return (profile_id, *base.values())
